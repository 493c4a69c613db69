"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Everything here is built of SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import count_below, matches, once, running

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match that fails its length only has shorter runs inside, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What joins the parts of a run; a part keeps the ones after it.
JOINTS = "=/_+-"
PART = r"[^=/_+-]+[=/_+-]*|[=/_+-]+"
#: A stretch of parts ends where its score has fallen by so many nats.
DROP = 10.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Parts of ordinary identifiers for the labelled samples.
PARTS = (
    "account action address agent array async attribute author backup balance base batch border bucket buffer build button cache "
    "callback category center channel check client cloud cluster code column command commit common config connection container "
    "content context control count create customer data database date default delete detail device directory document domain "
    "download driver dynamic editor element email encode engine entity entry error event example export factory feature field file "
    "filter folder format forward frame function gateway global group handler header height history host image import index info "
    "input instance internal invoice item iterator java job json kernel label language layout length level library license limit "
    "link list listener load local location logger login main manager mapping master memory merge message method metric mobile mode "
    "model module monitor name network node notification number object offset operation option order output package page parameter "
    "parent parser partition path pattern payment performance permission platform player plugin pointer policy pool position prefix "
    "process product profile project property protocol provider proxy public query queue random range reader record region register "
    "release remote render report repository request resource response result return role root router sample schedule schema scope "
    "script search section security select sender server service session setting shared signal simple size sort source stack start "
    "state static status storage stream string structure style submit summary support system table target task template test text "
    "thread time title toolbar tracker transaction transform type update upload user utility validate value variable vector version "
    "video view visitor web widget width window worker write zone"
).split()


def labelled_samples(spark: SparkSession, n: int = 6000, salt: str = "train") -> DataFrame:
    """``token, random``: ``n`` labelled samples, the same for the same ``salt``.

    Random ones are base64, base62 and hexadecimal digests; the others are identifiers of two to
    five ordinary parts joined in the usual ways, some with a number.
    """
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    words = F.array(*map(F.lit, PARTS))
    nth = lambda k: F.element_at(words, (F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("int") % len(PARTS) + 1).cast("int"))
    chosen = F.slice(F.array(*(nth(k) for k in range(1, 6))), 1, (F.col("id") % 4 + 2).cast("int"))
    style = F.col("id") % 6
    name = (
        F.when(style == 0, F.array_join(chosen, "_"))
        .when(style == 1, F.array_join(F.transform(chosen, F.initcap), ""))
        .when(style == 2, F.array_join(chosen, "-"))
        .when(style == 3, F.array_join(chosen, "/"))
        .when(style == 4, F.upper(F.array_join(chosen, "_")))
        .otherwise(F.array_join(chosen, ""))
    )
    name = F.when(F.col("id") % 5 == 0, F.concat(name, F.lit("_"), (F.col("id") % 2030).cast("string"))).otherwise(name)
    coded = F.base64(F.unhex(digest))
    key = F.when(F.col("id") % 3 == 0, coded).when(F.col("id") % 3 == 1, F.regexp_replace(coded, "[+/=]", "")).otherwise(F.substring(digest, 1, 40))
    ids = spark.range(n)
    return ids.select(name.alias("token"), F.lit(False).alias("random")).union(ids.select(key.alias("token"), F.lit(True).alias("random")))


def train_markov(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of all pairs of ``ALPHABET`` characters, row by row.

    ``samples`` has ``token`` and ``random``; pairs with other characters and null tokens are
    passed over.  Transition probabilities are smoothed by half a count; without samples all ratios are 0.
    """
    pairs = samples.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - 1, F.lit(1))), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.where(F.length("pair") == 2).groupBy("random", "pair").agg(F.count("*").alias("n")).where("random is not null").collect() if all(c in ALPHABET for c in r["pair"])}
    size, out = len(ALPHABET), []
    for a in ALPHABET:
        total = {kind: sum(counts.get((kind, a + b), 0) for b in ALPHABET) + size / 2 for kind in (True, False)}
        out += [math.log((counts.get((True, a + b), 0) + 0.5) / total[True]) - math.log((counts.get((False, a + b), 0) + 0.5) / total[False]) for b in ALPHABET]
    return out


def _chars(token: Column) -> Column:
    return F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0))


def _mean_ratio(chars: Column, table: list[float]) -> Column:
    # As texts, which Spark folds into one constant each; an unknown character's code leads out of the table.
    ratios = F.split(F.lit(" ".join(map(repr, map(float, table)))), " ").cast("array<double>")
    known = {c: k for k, c in enumerate(ALPHABET)}
    codes = F.split(F.lit(" ".join(str(known.get(chr(c), -(10**6))) for c in range(128))), " ").cast("array<int>")

    def mean(code: Column) -> Column:
        step = lambda acc, i: acc + F.coalesce(F.get(ratios, F.get(code, i - 1) * len(ALPHABET) + F.get(code, i)), F.lit(0.0))
        return F.when(F.size(code) >= 2, F.aggregate(F.sequence(F.lit(1), F.size(code) - 1), F.lit(0.0), step) / (F.size(code) - 1)).otherwise(F.lit(0.0))

    return once(F.transform(chars, lambda c: F.get(codes, F.ascii(c))), mean)


def log_ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions; 0 for fewer than two characters."""
    return _mean_ratio(_chars(token), table)


#: Stretches of one chunk of a growing list, so that adding one does not copy all before it.
CHUNK = 256


def _stretches(run: Column, model: list[float], min_ratio: float) -> Column:
    """Stretches of whole parts of a run (a struct of start, end and value) that score above ``min_ratio``, by running sums.

    A part scores its log-likelihood ratio less ``min_ratio`` a transition.  A stretch goes from
    where the sum last was 0 to its peak, and is closed once the sum falls to 0 or by ``DROP``.
    """
    scored = F.transform(F.regexp_extract_all(run["value"], F.lit(PART), F.lit(0)), lambda p: F.struct(F.length(p).alias("n"), ((log_ratio(p, model) - min_ratio) * (F.length(p) - 1)).alias("gain")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def closed(acc: Column) -> Column:
        """The open chunk with the stretch that ends, if it is long enough to be reported."""
        span = F.struct(acc["start"].alias("start"), acc["end"].alias("end"))
        return F.when((acc["best"] > 0) & (acc["end"] - acc["start"] >= 20), F.concat(acc["chunk"], F.array(span))).otherwise(acc["chunk"])

    def step(acc: Column, p: Column) -> Column:
        total, at = acc["sum"] + p["gain"], acc["at"] + p["n"]
        over, higher = (total <= 0) | (total < acc["best"] - DROP), total > acc["best"]
        full = F.size(acc["chunk"]) >= CHUNK
        return F.struct(
            at.alias("at"),
            F.when(over, at).otherwise(acc["start"]).alias("start"),
            F.when(over, F.lit(0.0)).otherwise(total).alias("sum"),
            F.when(over, F.lit(0.0)).when(higher, total).otherwise(acc["best"]).alias("best"),
            F.when(higher, at).otherwise(acc["end"]).alias("end"),
            F.when(full, none).when(over, closed(acc)).otherwise(acc["chunk"]).alias("chunk"),
            F.when(full, F.concat(acc["chunks"], F.array(F.when(over, closed(acc)).otherwise(acc["chunk"])))).otherwise(acc["chunks"]).alias("chunks"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("end"), none.alias("chunk"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("chunks"))
    found = F.aggregate(scored, begin, step, lambda acc: F.flatten(F.concat(acc["chunks"], F.array(closed(acc)))))

    def report(chars: Column) -> Column:
        text = lambda x: F.rtrim(F.array_join(F.transform(F.sequence(x["start"], x["end"] - 1), lambda i: chars[i]), ""), F.lit(JOINTS))
        values = F.transform(found, lambda x: F.struct((run["start"] + x["start"]).alias("start"), text(x).alias("value")))
        long = F.filter(values, lambda x: (F.length(x["value"]) >= 20) & (log_ratio(x["value"], model) >= min_ratio))
        return F.transform(long, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))

    return once(_chars(run["value"]), report)


def _kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end")))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", names[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, *, model: list[float] | None = None, min_ratio: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_markov, base_spans, spans`` of each whole text.

    Spans are ``kind:start:end`` in code points, ends exclusive, by start, then kind.  The first
    three kinds are fixed patterns (leftmost, not overlapping, matches that are too short
    dropped); ``markov`` are runs of 20 or more token characters that meet no other span and
    whose transitions are likelier in random strings than in identifiers by ``min_ratio`` nats
    each; of other runs, the stretches of 20 or more characters between ``JOINTS`` that are so
    (see ``_stretches``).  ``model`` is what ``train_markov`` returns; by default it is trained on
    ``labelled_samples``.

    A pure projection: no shuffle, and every row for itself, so ties and repeated rows need no
    care.  Time grows with n log n of a text's matches.  Null and empty texts have no spans.  Other columns are not read.
    """
    if model is None:
        model = train_markov(labelled_samples(docs.sparkSession))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.filter(matches(F.col("text"), ASSIGN, 1), lambda x: F.length(x["value"]) >= 8).alias("assign"),
        matches(F.col("text"), ACCESS).alias("access"),
        matches(F.col("text"), HEX).alias("hex"),
        matches(F.col("text"), CANDIDATE).alias("tokens"),
    )
    base = F.array_sort(F.concat(_kind(F.col("assign"), "assign"), _kind(F.col("access"), "access"), _kind(F.col("hex"), "hex")))
    rows = rows.withColumn("base", base)
    rows = rows.withColumns({"starts": F.transform("base", lambda y: y["start"]), "tops": running(F.transform("base", lambda y: y["end"]), F.greatest)})

    def apart(x: Column) -> Column:
        """Whether a span meets no base span: of those that begin before its end, none ends after its start."""
        return once(count_below(F.col("starts"), x["end"]), lambda n: F.when(n == 0, True).otherwise(F.get("tops", n - 1) <= x["start"]))

    inside = F.flatten(F.transform("tokens", lambda x: F.when(apart(x) & (log_ratio(x["value"], model) >= min_ratio), F.array(x)).otherwise(_stretches(x, model, min_ratio))))
    markov = F.filter(inside, apart)
    rows = rows.select("*", F.when(F.size("tokens") > 0, _kind(markov, "markov")).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>")).alias("markov"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, _joined(F.col("base")).alias("base_spans"), _joined(F.concat("base", "markov")).alias("spans"))
