"""Formats that users plug in: tokenizers from documents to nodes, and renderers back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    tokenize: Transform
    render: Transform | None = None
    capabilities: frozenset[str] = frozenset()


@dataclass
class Registry:
    formats: dict[str, Format] = field(default_factory=dict)

    def register(self, f: Format, replace: bool = False) -> None:
        if f.name in self.formats and not replace:
            raise ValueError(f"format {f.name} is registered")
        for other in self.formats.values():
            if other.name != f.name and (both := set(other.extensions) & set(f.extensions)):
                raise ValueError(f"FORMAT_EXTENSION_CONFLICT {sorted(both)}")
        self.formats[f.name] = f

    def unregister(self, name: str) -> None:
        del self.formats[name]

    def convert(self, docs: DataFrame, source: str, target: str) -> DataFrame:
        """Documents of one format as those of another that can render nodes."""
        to = self.formats[target]
        if to.render is None:
            raise ValueError(f"format {target} renders nothing")
        return to.render(self.formats[source].tokenize(docs))
