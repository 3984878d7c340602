"""What Spark's expressions cannot state: NFKC, front matter, similarity ratio, stems, embeddings.

Each is a scalar Pandas UDF over Arrow batches.
"""

from __future__ import annotations

import difflib
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\Z)", re.S)


def entity_key(name: str | None) -> str | None:
    """SC-1: NFKC, white space collapsed, case folded."""
    return None if name is None else " ".join(unicodedata.normalize("NFKC", name).split()).casefold()


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?\d*\.\d+", text):
        return float(text)
    if text[0] == "[" and text[-1] == "]":
        parts, depth, at = [], 0, 1
        for i in range(1, len(text)):
            c = text[i]
            if depth == 0 and c in ",]":
                if text[at:i].strip():
                    parts.append(_scalar(text[at:i]))
                at = i + 1
            depth += (c == "[") - (c == "]")
        return parts
    if text[0] in "{&*|>%@`":
        raise ValueError(f"not supported in front matter: {text[:20]}")
    return text


def parse_block(lines: list[tuple[int, str]], indent: int):
    """A mapping or list of plain front matter: scalars, quoted text, flow lists, nested blocks."""
    if lines and lines[0][1].startswith("- "):
        out: list = []
        while lines and lines[0][0] == indent and lines[0][1].startswith("- "):
            first = lines[0][1][2:].strip()
            lines.pop(0)
            if re.match(r"[\w ]+:(\s|$)", first):
                inner = [(indent + 2, first)]
                while lines and lines[0][0] > indent:
                    inner.append((max(indent + 2, lines[0][0]), lines.pop(0)[1]))
                out.append(parse_block(inner, indent + 2))
            else:
                out.append(_scalar(first))
        return out
    made: dict = {}
    while lines and lines[0][0] == indent:
        m = re.match(r"(\"[^\"]*\"|'[^']*'|[^:]+):(?:\s+(.*))?$", lines[0][1])
        if not m:
            raise ValueError(f"not a mapping: {lines[0][1][:40]}")
        key, value = m[1].strip("\"' "), m[2]
        lines.pop(0)
        if value is None or not value.strip():
            deeper = bool(lines) and (lines[0][0] > indent or lines[0][0] == indent and lines[0][1].startswith("- "))
            made[key] = parse_block(lines, lines[0][0]) if deeper else None
        else:
            made[key] = _scalar(value)
    if lines and lines[0][0] > indent:
        raise ValueError(f"bad indent: {lines[0][1][:40]}")
    return made


def front_matter(raw: str | None) -> tuple[dict, str]:
    """PRJ-1: (mapping, body); ValueError if the block is malformed or no mapping."""
    m = FRONT.match(raw or "")
    if not m:
        return {}, raw or ""
    lines = []
    for line in m[1].splitlines():
        bare = re.sub(r"(^|\s)#(?=\s).*$", "", line).rstrip()
        if bare.strip():
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))
    made = parse_block(lines, lines[0][0]) if lines else {}
    if lines or not isinstance(made, dict):
        raise ValueError("front matter is not a mapping")
    return made, raw[m.end() :]


def _parsed(raw: str | None) -> tuple[str | None, str, str | None]:
    try:
        meta, body = front_matter(raw)
        return json.dumps(meta, default=str, ensure_ascii=False), body, None
    except ValueError as e:
        return None, raw or "", str(e)


def ratio(a: str, b: str) -> float:
    """SC-20: Ratcliff-Obershelp similarity."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def surely_different(a: str, b: str, threshold: float) -> bool:
    """Bounds of the ratio that are cheap: by length, then by character counts."""
    if not a and not b:
        return False
    if 2 * min(len(a), len(b)) / (len(a) + len(b)) <= threshold:
        return True
    return difflib.SequenceMatcher(None, a, b).quick_ratio() <= threshold


def fake_embedding(text: str, dim: int = 384) -> list[float]:
    """UX-1: a deterministic vector in -1..1 from SHA-256 digests; for tests and offline runs."""
    out: list[float] = []
    i = 0
    while len(out) < dim:
        digest = hashlib.sha256(f"{text}:{i}".encode()).digest() if i else hashlib.sha256(text.encode()).digest()
        out += [b / 127.5 - 1.0 for b in digest]
        i += 1
    return out[:dim]


#: Lower-case letters and digits, as ``text.tokens`` has them.
TOKEN = re.compile(r"[a-z0-9]+")


class _Places(dict):
    """token -> 32 bits of its MD5; forgets all when it has grown."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
        return h


_PLACES = _Places()


def hashed_embeddings(texts: list[str], dim: int = 256) -> np.ndarray:
    """UX-1: the offline provider that knows words: signed counts of a text's
    tokens, at place h % dim with the sign of the bit above (``dim`` is a power of
    two).  Texts that share words are near by cosine; nothing is learned.
    Whole numbers, so exact."""
    found = [TOKEN.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, count=len(found))
    h = np.fromiter(map(_PLACES.__getitem__, itertools.chain.from_iterable(found)), np.int64, count=int(sizes.sum()))
    at = np.repeat(np.arange(len(texts)), sizes) * dim + h % dim
    out = np.bincount(at, 1.0 - 2 * (h // dim % 2), len(texts) * dim)
    return out.reshape(len(texts), dim).astype(np.float32)


def porter_stem(w: str) -> str:
    """A light English stemmer after Porter (1980), steps 1a-1c, for the optional analyser."""
    vowel = re.compile(r"[aeiou]|(?<=[^aeiou])y")
    if len(w) <= 2:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if vowel.search(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel.search(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and vowel.search(w[:-1]):
        w = w[:-1] + "i"
    return w


def entity_key_udf():
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(entity_key)

    return f


def front_matter_udf():
    """raw -> struct(meta JSON, body, error)."""

    @F.pandas_udf("meta string, body string, error string")
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parsed(x) for x in s], columns=["meta", "body", "error"])

    return parse


def ratio_udf():
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return f


def embed_udf(provider: Callable[[list[str]], list[list[float]] | np.ndarray] | None = None, dim: int = 384, most: int | None = None):
    """UX-1, UX-2: text -> vector.  ``provider`` embeds a batch.  A text over
    ``most`` characters is halved until its parts fit; their vectors are
    averaged by length and normalised."""

    def batch(texts: list[str]) -> list:
        return list(provider(texts)) if provider else [fake_embedding(t, dim) for t in texts]

    def whole(text: str) -> list[float]:
        if most is None or len(text) <= most:
            return batch([text])[0]
        cut = len(text) // 2
        a, b = text[:cut], text[cut:]
        v = np.array(whole(a)) * len(a) + np.array(whole(b)) * len(b)
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    @F.pandas_udf("array<float>")
    def f(s: pd.Series) -> pd.Series:
        texts = ["" if x is None else x for x in s]
        if most is None or max(map(len, texts), default=0) <= most:
            return pd.Series(batch(texts), dtype=object)
        return pd.Series([whole(t) for t in texts], dtype=object)

    return f


def stems_udf():
    """SC-5, optional: tokens -> distinct stems."""

    @F.pandas_udf("array<string>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: list(dict.fromkeys(porter_stem(w) for w in ws)))

    return f
