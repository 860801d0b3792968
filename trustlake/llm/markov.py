"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import seeded, small_batches

KINDS = ("assign", "access", "hex", "markov")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the models look at: runs of key characters of this length or more.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # and the start of a string
_CODE = np.full(128, SIZE - 1)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(SIZE - 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern matches as ``start, kind number, end``-ordered tuples ``(start, end, kind)``; offsets are code points."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def _codes(string: str) -> np.ndarray:
    return _CODE[np.frombuffer(string.encode("ascii"), dtype=np.uint8)]


def _pairs(string: str) -> np.ndarray:
    codes = _codes(string)
    return np.concatenate([[SIZE - 1], codes[:-1]]) * SIZE + codes


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratio of each character transition, random string over ordinary identifier."""

    ratio: np.ndarray
    cut: float = 12.0  # natural log: odds of e^12 that the run is random
    per_char: float = 0.35

    def score(self, string: str) -> float:
        return float(self.ratio[_pairs(string)].sum())

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Runs called random that no base span touches."""
        found = []
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            if any(s < end and start < e for s, e, _ in base):
                continue
            score = self.score(m[0])
            if score >= self.cut and score >= self.per_char * (end - start):
                found.append((start, end, "markov"))
        return found


def transition_counts(samples: DataFrame) -> DataFrame:
    """``secret, pair, n`` from rows of ``string, secret``: transitions of both classes, at most two alphabets squared."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, SIZE * SIZE), dtype=np.int64)
        for batch in batches:
            kinds = batch["secret"].astype("boolean").fillna(False).to_numpy(dtype=bool)
            known = batch["secret"].notna().to_numpy()
            for secret in (False, True):
                strings = [t for t in batch["string"][known & (kinds == secret)] if t is not None and t.isascii()]
                # A character outside the alphabet has the code of a start, as the break between strings has.
                codes = _codes("\0" + "\0".join(strings))
                pairs = (codes[:-1] * SIZE + codes[1:])[codes[1:] < SIZE - 1]
                held[int(secret)] += np.bincount(pairs, minlength=SIZE * SIZE)
        kind, pair = np.nonzero(held)
        yield pd.DataFrame({"secret": kind.astype(bool), "pair": pair.astype(np.int32), "n": held[kind, pair]})

    return samples.mapInPandas(count, "secret boolean, pair int, n long").groupBy("secret", "pair").agg(F.sum("n").alias("n"))


def fit_markov(samples: DataFrame, prior: float = 0.5, uniform: float = 50.0) -> SecretModel:
    """Train both chains on labelled strings (``string, secret``); rows with a null teach nothing.

    The chain of random strings starts from ``uniform`` pseudo-counts a row, spread evenly over the key alphabet: random
    strings of an alphabet not among the samples are still random. With no sample at all nothing is called secret.
    """
    counts = np.zeros((2, SIZE * SIZE))
    for r in transition_counts(samples).collect():  # two classes times the alphabet squared
        counts[int(r["secret"]), r["pair"]] = r["n"]
    if not counts[0].any():
        return SecretModel(np.full(SIZE * SIZE, -1.0))
    tables = []
    for chain, extra in zip(counts.reshape(2, SIZE, SIZE), (prior, uniform / (SIZE - 1))):
        chain = chain[:, :-1] + extra
        tables.append(np.log(chain / chain.sum(axis=1, keepdims=True)))
    ratio = np.full((SIZE, SIZE), 0.0)
    ratio[:, :-1] = tables[1] - tables[0]
    return SecretModel(ratio.reshape(-1))


def labelled_strings(docs: DataFrame, max_docs: int = 20_000, seed: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``string, secret`` from about ``max_docs`` documents (a bound of the training only; scanning reads every row).

    Values that a base pattern marks are the secrets; runs of six key characters or more outside of such spans are the
    ordinary identifiers, each once a document, as long as they do not mix letters and digits as keys do.
    """
    small_batches(docs.sparkSession)
    part = min(1.0, max_docs / max(1, docs.count()))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.where(seeded(seed, F.col("id"), F.octet_length("text")) < part)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            strings, secret = [], []
            for text in batch["text"]:
                base = base_spans(text)
                values = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if base else []
                values = [v for v in values if "." not in v] + [text[s:e] for s, e, k in base if k != "assign"]
                strings += values
                secret += [True] * len(values)
                plain = set()
                for m in IDENTIFIER.finditer(text):
                    if not any(s < m.end() and m.start() < e for s, e, _ in base):
                        plain.add(m[0])
                plain = [p for p in plain if not (DIGIT.search(p) and LETTER.search(p))]
                strings += plain
                secret += [False] * len(plain)
            yield pd.DataFrame({"string": pd.Series(strings, dtype=object), "secret": pd.Series(secret, dtype=bool)})

    return rows.select("text").mapInPandas(label, "string string, secret boolean")


def scan_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans`` per row; texts are scanned whole.

    A null text counts as empty: no span, the digest of the empty string. Repeated rows are scanned alike, a null id stays
    null, other columns play no part, an empty table gives no row.
    """
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                base = base_spans(text or "")
                more = model.spans(text or "", base)
                kinds = [k for _, _, k in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((*(kinds.count(k) for k in KINDS[:3]), len(more), digest, joined(base + more)))
            found = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])
            yield pd.concat([batch["doc_id"].reset_index(drop=True).astype(object), found], axis=1)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(
        scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    )
