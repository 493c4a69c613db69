"""See the package docstring of tickframe."""
