"""Question generators behind one interface: a language model if one is plugged in, else heuristics."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import heuristic_questions, parse_questions, prompt
from pagewright.plugins import LanguageModel


@dataclass(frozen=True)
class QuestionConfig:
    model_name: str = ""
    device: str | None = None
    max_new_tokens: int = 100
    temperature: float = 0.7
    top_p: float = 0.9
    num_questions_per_chunk: int = 3
    prompt_template: str = "Write questions that this text answers, one a line:\n\n%s\n\nQuestions:"


class QuestionGenerator(ABC):
    @abstractmethod
    def questions(self, text: Column, n: int) -> Column:
        """ARRAY<STRING> of at most n questions."""


class HeuristicGenerator(QuestionGenerator):
    def questions(self, text: Column, n: int) -> Column:
        return heuristic_questions(text, n)


class ModelGenerator(QuestionGenerator):
    """Answers of a plugged-in model, parsed by the cascade; a text on which the model fails gets no questions."""

    def __init__(self, make: Callable[[], LanguageModel], config: QuestionConfig = QuestionConfig()):
        self.make, self.config = make, config

    def questions(self, text: Column, n: int) -> Column:
        make, c = self.make, self.config
        settings = {"max_new_tokens": c.max_new_tokens, "temperature": c.temperature, "top_p": c.top_p, "device": c.device}

        @F.pandas_udf("string")
        def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = make()
            for batch in batches:
                try:
                    yield pd.Series(model(batch.tolist(), **settings), dtype=object)
                except Exception:  # isolate the text that fails
                    out = []
                    for x in batch:
                        try:
                            out.append(model([x], **settings)[0])
                        except Exception:
                            out.append("")
                    yield pd.Series(out, dtype=object)

        asked = prompt(self.config.prompt_template, text)
        return parse_questions(answer.asNondeterministic()(asked), n, asked)


def get_generator(make: Callable[[], LanguageModel] | None = None, config: QuestionConfig = QuestionConfig(), fallback: bool = True) -> QuestionGenerator:
    """The model's generator if the model can be made here, else the heuristic one, or the error if `fallback` is off."""
    if make is None:
        if not fallback:
            raise ValueError("no language model is plugged in")
        return HeuristicGenerator()
    try:
        make()
    except Exception:
        if not fallback:
            raise
        return HeuristicGenerator()
    return ModelGenerator(make, config)
