"""Plug-in points with offline defaults: token counters, embedders, page parsers, language models."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

#: Number of tokens of a text.
TokenCounter = Callable[[str], int]


def whitespace_tokens(text: str) -> int:
    return len(text.split())


class Embedder(ABC):
    """Texts to vectors; made once per worker."""

    dim: int

    @abstractmethod
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class PageParser(ABC):
    """The bytes of a document to (text, width, height) by page."""

    @abstractmethod
    def __call__(self, content: bytes) -> list[tuple[str, float | None, float | None]]: ...


class LanguageModel(ABC):
    """Prompts to answers, under the settings max_new_tokens, temperature, top_p and device; there is none offline."""

    @abstractmethod
    def __call__(self, prompts: list[str], **settings) -> list[str]: ...
