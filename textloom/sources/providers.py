"""Clients for the models that may be injected: token counts, embeddings, merge decisions, vision. Plain HTTP and JSON.

Each is a picklable callable that is built once in a worker. Calls go to services, so they are the slow path: the helpers
here call a service once per distinct text.
"""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Post = Callable[[str, dict, dict[str, str], float], dict]

#: Our own wordings; a deployment may give others.
PROMPTS = {
    "boundary": {"merge": "Two neighbouring parts of a document follow as JSON. Answer {\"decision\": \"merge\"} if the second continues the first's thought, else {\"decision\": \"keep\"}."},
    "vision": {
        "image": "List what this picture shows as text, in reading order, as JSON: {\"nodes\": [{\"node_type\": \"title|paragraph|table|list\", \"level\": 0, \"text\": \"...\"}]}.",
        "region": "The picture is a part of a page. List its text as JSON nodes as above; leave out what is only decoration.",
        "scan": "The picture is a scanned page. List its text in reading order as JSON nodes as above.",
    },
}


def post_json(url: str, payload: dict, headers: dict[str, str], seconds: float) -> dict:
    request = urllib.request.Request(url, json.dumps(payload, ensure_ascii=False).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=seconds) as answer:
        return json.load(answer)


def prompt(*path: str, prompts: dict | None = None) -> str:
    """The text at a path of the prompt table; KeyError where there is none, ValueError where it is no text."""
    found = PROMPTS if prompts is None else prompts
    for key in path:
        if not isinstance(found, dict) or key not in found:
            raise KeyError("/".join(path))
        found = found[key]
    if not isinstance(found, str):
        raise ValueError(f"no text at {'/'.join(path)}")
    return found.strip()


@dataclass(frozen=True)
class Models:
    """Which models and services hold; without a small model the text model decides."""

    text: str | None = None
    flash: str | None = None
    vision: str | None = None
    embedding_url: str | None = None
    embedding: str | None = None
    embedding_key: str | None = None

    @property
    def decider(self) -> str | None:
        return self.flash or self.text


@dataclass
class HttpTokenCounter:
    """POSTs {input}; takes token_count or count. Blank texts have none without a call; errors are raised."""

    url: str
    seconds: float = 10
    post: Post = post_json

    def __call__(self, text: str) -> int:
        bare = text.strip()
        return _counted(self.url, self.seconds, self.post, bare) if bare else 0


@lru_cache(maxsize=4096)
def _counted(url: str, seconds: float, post: Post, text: str) -> int:
    answer = post(url, {"input": text}, {}, seconds)
    for key in ("token_count", "count"):
        if isinstance(answer, dict) and isinstance(answer.get(key), int):
            return answer[key]
    raise ValueError("the answer has no token count")


def counted_tokens(rows: DataFrame, text: str, counter: Callable[[str], int], out: str = "tokens") -> DataFrame:
    """Adds token counts; each distinct text is counted once over the whole table."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(counter)

    distinct = rows.select(text).where(F.col(text).isNotNull()).distinct().withColumn(out, count(text))
    return rows.join(distinct, text, "left")


def judged(pairs: DataFrame, left: str, right: str, scorer: Callable[[str, str], float], decider: Callable[[str, str], bool]) -> DataFrame:
    """Adds the score of two texts (null where the service fails) and whether the decider says merge."""

    @F.pandas_udf("struct<score:double,says_merge:boolean>")
    def judge(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        scores = []
        for x, y in zip(a, b):
            try:
                scores.append(scorer(x, y))
            except Exception:  # a strategy of its own, see boundary.decision
                scores.append(None)
        return pd.DataFrame({"score": pd.Series(scores, dtype="float64"), "says_merge": [decider(x, y) for x, y in zip(a, b)]})

    return pairs.withColumn("judged", judge(left, right)).select("*", "judged.score", "judged.says_merge").drop("judged")


def cosine(a: list[float], b: list[float]) -> float:
    norms = math.hypot(*a) * math.hypot(*b)
    if not a or len(a) != len(b) or norms == 0:
        raise ValueError("vectors must have one length and not be zero")
    return sum(x * y for x, y in zip(a, b)) / norms


@dataclass
class EmbeddingScorer:
    """The cosine of two texts' embeddings, both asked for in one call."""

    models: Models
    seconds: float = 10
    post: Post = post_json

    def __call__(self, left: str, right: str) -> float:
        if not self.models.embedding_url or not self.models.embedding:
            raise RuntimeError("no embedding service is set")
        headers = {"Authorization": f"Bearer {self.models.embedding_key}"} if self.models.embedding_key else {}
        answer = self.post(self.models.embedding_url, {"input": [left, right], "model": self.models.embedding}, headers, self.seconds)
        return cosine(answer["data"][0]["embedding"], answer["data"][1]["embedding"])


@dataclass
class ChatModel:
    """Text and vision calls to a service of the usual chat form, at temperature 0.1."""

    url: str
    key: str | None = None
    seconds: float = 30
    post: Post = post_json
    temperature: float = 0.1

    def _ask(self, model: str, messages: list[dict], thinking: bool) -> str:
        payload = {"model": model, "messages": messages, "temperature": self.temperature, **({"thinking": {"enabled": True}} if thinking else {})}
        answer = self.post(self.url, payload, {"Authorization": f"Bearer {self.key}"} if self.key else {}, self.seconds)
        return (answer["choices"][0]["message"]["content"] or "").strip()

    def text(self, model: str, system: str, payload: dict, thinking: bool = False) -> str:
        return self._ask(model, [{"role": "system", "content": system}, {"role": "user", "content": json.dumps(payload, ensure_ascii=False)}], thinking)

    def vision(self, model: str, question: str, data_url: str, thinking: bool = False) -> str:
        return self._ask(model, [{"role": "user", "content": [{"type": "text", "text": question}, {"type": "image_url", "image_url": {"url": data_url}}]}], thinking)


@dataclass
class ModelDecider:
    """Whether a model says merge; no model or a failing one keeps the parts."""

    chat: ChatModel | None
    models: Models = field(default_factory=Models)
    chars: int = 1200

    def __call__(self, left: str, right: str) -> bool:
        if self.chat is None or not self.models.decider:
            return False
        try:
            answer = self.chat.text(self.models.decider, prompt("boundary", "merge"), {"left": left[: self.chars], "right": right[: self.chars]})
            return json.loads(answer).get("decision") == "merge"
        except Exception:  # a failing service keeps the parts
            return False
