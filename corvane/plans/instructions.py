"""Instruction and task-definition generators: prompts, required parts, a cache by content, and a review hook.

These run on the driver: one call a task, not one a row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np

from ..functions.json5 import fenced
from .checks import missing_parts
from .models import Completer, Embedder


@dataclass(frozen=True)
class Task:
    """What a query asks for, what a document is, and when the two belong together."""

    name: str
    query_type: str
    doc_type: str
    relevance: str


def examples_block(examples: Sequence[Mapping[str, str]]) -> str:
    """Numbered examples; a negative is shown where there is one."""
    out = []
    for n, e in enumerate(examples, 1):
        lines = [f"Example {n}", f"Query: {e['query']}", f"Relevant: {e['positive']}"]
        if e.get("negative"):
            lines.append(f"Not relevant: {e['negative']}")
        out.append("\n".join(lines))
    return "\n\n".join(out)


def query_prompt(task: Task, examples: Sequence[Mapping[str, str]], previous: str = "", feedback: str = "") -> str:
    """Asks for an instruction by which queries of a task are written."""
    parts = [f"Write an instruction for producing {task.query_type} whose answers are {task.doc_type}.", f"A document is relevant if {task.relevance}.", examples_block(examples)]
    if previous:
        parts.append(f"Improve this version:\n{previous}\nBecause: {feedback}")
    return "\n\n".join(p for p in parts if p)


def label_prompt(task: Task, examples: Sequence[Mapping[str, str]], previous: str = "", feedback: str = "") -> str:
    """Asks for an instruction by which candidates of a task are labelled 0 to 3."""
    parts = [f"Write an instruction for grading {task.doc_type} against {task.query_type} from 0 to 3.", f"Grade 3 means that {task.relevance}.", examples_block(examples)]
    if previous:
        parts.append(f"Improve this version:\n{previous}\nBecause: {feedback}")
    return "\n\n".join(p for p in parts if p)


def generate(prompt: str, required: Sequence[str], completer: Completer, attempts: int = 3) -> str:
    """An instruction that has all required parts; raises after the last attempt without one."""
    lacking: list[str] = []
    for _ in range(attempts):
        got = completer.complete([prompt])[0]
        lacking = missing_parts(got, required)
        if got.strip() and not lacking:
            return got
    raise ValueError(f"no usable instruction; missing {lacking}")


def define_task(name: str, examples: Sequence[Mapping[str, str]], completer: Completer, cache: dict[str, dict]) -> Task:
    """A task's definition from examples; equal examples are asked about once."""
    key = hashlib.md5(json.dumps([name, *examples], sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:8]
    if key not in cache:
        cache[key] = fenced(completer.complete([f"Describe the retrieval task {name} as JSON with query_type, doc_type and relevance.\n\n{examples_block(examples)}"])[0])
    return Task(name, *(str(cache[key][k]) for k in ("query_type", "doc_type", "relevance")))


def reviewed(decide: Callable[[str], str | None], default: bool = True) -> Callable[[str, bool, str], tuple[bool, str] | None]:
    """A review for ``refine``: the reviewer's empty answer accepts, a text is feedback, no answer leaves the check."""

    def review(artefact: str, ok: bool, feedback: str) -> tuple[bool, str] | None:
        said = decide(artefact)
        return None if said is None else (said == "" and default, said)

    return review


class PromptedEmbedder:
    """An embedder that puts a task's prompt before each text."""

    def __init__(self, inner: Embedder, prompt: str):
        self.inner, self.prompt = inner, prompt

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return self.inner.embed([self.prompt + (t or "") for t in texts])
