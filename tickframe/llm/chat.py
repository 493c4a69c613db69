"""Chat formatting: token-level assembly of conversations with loss masks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..code import share_code
from .shared import slices

START, END = "<|im_start|>", "<|im_end|>"
#: Every control string begins so; content never holds it once it is escaped.
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
#: Tokens of one output row; a longer conversation takes several rows.
ROW_TOKENS = 4_000_000


def escape(text: str) -> str:
    """One backslash more between each ``<`` and ``|``, so that no control string is left; ``unescape`` takes it back."""
    return _OPENING.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role in one line: a line break is ``\\n`` and a backslash two, before ``escape``."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(role))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text here
    return t


def reserved_ids(path: str) -> dict[str, int]:
    """The ids spliced in for the control strings: the first two above the vocabulary."""
    size = _tokenizer(path).get_vocab_size(with_added_tokens=True)
    return {START: size, END: size + 1}


def encode_turns(conversations: DataFrame, *, tokenizer_path: str, train_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each turn's segments, encoded by themselves: ``conv_id, turn, role, text, ids, head, body, trained``.

    ``ids`` is START, the role and a line break, the content, END and a line break; ``head`` and
    ``body`` are the numbers of tokens before and in the content.  Roles (to one line) and contents are
    escaped first, so reserved ids are the only marks in the output.
    """
    kinds = dict(conversations.dtypes)
    share_code(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, mark = _tokenizer(tokenizer_path), reserved_ids(tokenizer_path)
        heads: dict[str, list[int]] = {}
        newline = tok.encode("\n", add_special_tokens=False).ids
        for b in slices(batches, "text", 4 << 20):
            roles = [x or "" for x in b.column("role").to_pylist()]
            bodies = [e.ids for e in tok.encode_batch_fast([escape(x or "") for x in b.column("text").to_pylist()], add_special_tokens=False)]
            for r in {*roles} - {*heads}:
                heads[r] = [mark[START], *tok.encode(escape_role(r) + "\n", add_special_tokens=False).ids]
            ids = [np.array(heads[r] + body + [mark[END], *newline], np.int32).tobytes() for r, body in zip(roles, bodies, strict=True)]
            cols = [pa.array(ids, pa.binary()), pa.array([len(heads[r]) for r in roles], pa.int32()), pa.array(list(map(len, bodies)), pa.int32()), pa.array([r in train_roles for r in roles])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "turn", "role", "text")), *cols], names=["conv_id", "turn", "role", "text", "ids", "head", "body", "trained"])

    given = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"conv_id {kinds[conv_col]}, turn {kinds[turn_col]}, role string, text string, ids binary, head int, body int, trained boolean")


def format_chats(conversations: DataFrame, *, tokenizer_path: str, **options) -> DataFrame:
    """Conversations as token sequences: ``conv_id, part, n_turns, ids, loss_mask``.

    Turns are encoded where they lie, then meet by conversation in the order of turn, role and
    text; running sums of their token counts say where each content begins and ends, and so
    which tokens bear loss (``loss_mask`` 1): the contents of trained roles.  A task streams
    through sorted turns and holds one part, a run of turns of at most ``ROW_TOKENS`` tokens or
    a single longer one, so a long conversation is never gathered; parts are numbered from 0.

    Null texts and roles are empty; a null conversation id is a conversation; equal turns stay
    as often as they stand there.  Other columns are not read.  ``options`` as of ``encode_turns``.
    """
    turns = encode_turns(conversations, tokenizer_path=tokenizer_path, **options)
    kind = dict(turns.dtypes)["conv_id"]

    def part(key, number: int, turns: list[tuple[bytes, int, int, bool]]) -> tuple:
        ids = np.frombuffer(b"".join(x[0] for x in turns), np.int32)
        size = np.array([len(x[0]) // 4 for x in turns])
        begin = np.cumsum(size) - size + [x[1] for x in turns]
        trained = np.array([x[3] for x in turns])
        steps = np.zeros(len(ids) + 1, np.int32)
        np.add.at(steps, begin[trained], 1)
        np.add.at(steps, (begin + [x[2] for x in turns])[trained], -1)
        return key, number, len(turns), ids.tobytes(), np.cumsum(steps[:-1]).astype(np.int8).tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "ids", "head", "body", "trained")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for key, own in groupby(rows(batches), lambda x: x[0]):
            number, turns, size = 0, [], 0
            for _, ids, *rest in own:
                if turns and size + len(ids) > 4 * ROW_TOKENS:
                    out.append(part(key, number, turns))
                    held += size
                    number, turns, size = number + 1, [], 0
                turns.append((ids, *rest))
                size += len(ids)
            out.append(part(key, number, turns))
            held += size
            if held > 16 << 20:
                yield batch(out)
                out, held = [], 0
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "part", "n_turns", "ids", "loss_mask"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(turns.schema["conv_id"].dataType), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    met = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "head", "body", "trained")
    return met.mapInArrow(run, f"conv_id {kind}, part int, n_turns long, ids binary, loss_mask binary")


def read_back(ids: np.ndarray, loss_mask: np.ndarray, tokenizer_path: str) -> tuple[list[tuple[str, str]], list[str], int]:
    """Turns (role, text), the unescaped texts under the mask, and the formatted length in characters, of one row."""
    tok, mark = _tokenizer(tokenizer_path), reserved_ids(tokenizer_path)
    starts, ends = np.flatnonzero(ids == mark[START]), np.flatnonzero(ids == mark[END])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loss_mask, [0]])))
    pieces = [ids[a + 1 : b] for a, b in zip(starts, ends, strict=True)] + [ids[a:b] for a, b in edges.reshape(-1, 2)]
    spoken = tok.decode_batch([x.tolist() for x in pieces], skip_special_tokens=False)
    turns = [(unescape_role(role), unescape(text)) for role, text in (x.split("\n", 1) for x in spoken[: len(starts)])]
    chars = sum(len(x) + len(START) + len(END) + 1 for x in spoken[: len(starts)])
    return turns, [unescape(x) for x in spoken[len(starts) :]], chars
