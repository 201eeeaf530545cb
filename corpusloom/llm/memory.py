"""Memory of Python workers (``corpusloom.memory``)."""

from corpusloom.memory import release, released, sliced

__all__ = ["release", "released", "sliced"]
