"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import seeded, small_batches

DIMS = 1024
#: Labelled documents the prototypes are bundled from at most.
MAX_ROWS = 20_000
GAP = 32  # every run of other characters counts as one space
#: Distinct trigrams that are bound at once, and counted in one dense table.
SLICE = 4096
NOT_LETTERS = re.compile(r"[\W\d_]+")
SCALE = float(1 << 20)


class Space:
    """Random letter vectors of plus and minus one, drawn from the code point alone, and their bound trigrams."""

    def __init__(self, seed: int, dims: int = DIMS):
        self.seed, self.dims = seed, dims
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        found = self.letters.get(code)
        if found is None:
            draw = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims)
            found = self.letters[code] = (2 * draw - 1).astype(np.int8)
        return found

    def trigrams(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bound vectors: first letter permuted twice, second once, third as it is, multiplied element by element."""
        size = len(codes)
        a, rest = np.divmod(at, size * size)
        b, c = np.divmod(rest, size)
        held = np.unique(np.concatenate([a, b, c]))  # only the letters of this slice, however large the script
        plain = np.stack([self.letter(int(x)) for x in codes[held]]).astype(np.float32)
        once, twice = np.roll(plain, 1, axis=1), np.roll(plain, 2, axis=1)
        return twice[np.searchsorted(held, a)] * once[np.searchsorted(held, b)] * plain[np.searchsorted(held, c)]

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of each text and whether it has a letter: the sum of its trigram vectors, each as often as it occurs."""
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        plain = [f" {NOT_LETTERS.sub(' ', t.lower()).strip()} " if t else "  " for t in texts]
        has = np.array([len(p) > 2 for p in plain], dtype=bool)
        some = np.flatnonzero(has)
        for start in range(0, len(some), 64):
            rows = some[start:start + 64]
            runs = [np.frombuffer(plain[i].encode("utf-32-le"), dtype="<u4") for i in rows]
            whole = np.concatenate(runs)
            if whole.max() < 4096:
                seen = np.zeros(4096, dtype=bool)
                seen[whole] = True
                codes = np.flatnonzero(seen)
            else:
                codes = np.unique(whole)
            size = len(codes)
            place = np.searchsorted(codes, whole)
            ids = (place[:-2] * size + place[1:-1]) * size + place[2:]
            doc = np.repeat(np.arange(len(rows)), [len(r) for r in runs])
            inside = doc[:-2] == doc[2:]
            ids, doc = ids[inside], doc[:-2][inside]
            if size ** 3 <= 1 << 22:
                flag = np.zeros(size ** 3, dtype=bool)
                flag[ids] = True
                used = np.flatnonzero(flag)
                rank = np.cumsum(flag) - 1
                column = rank[ids]
            else:
                used, column = np.unique(ids, return_inverse=True)
            order = np.argsort(column, kind="stable") if len(used) > SLICE else slice(None)
            column, doc = column[order], doc[order]
            for low in range(0, len(used), SLICE):
                width = min(SLICE, len(used) - low)
                part = slice(*np.searchsorted(column, (low, low + width))) if len(used) > SLICE else slice(None)
                counts = np.bincount(doc[part] * width + column[part] - low, minlength=len(rows) * width).reshape(len(rows), width)
                out[rows] += counts.astype(np.float32) @ self.trigrams(codes, used[low:low + width])
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1), has


@dataclass(frozen=True)
class Prototypes:
    names: tuple[str, ...]
    vectors: np.ndarray  # one unit row per language
    seed: int

    def predict(self, space: Space, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        vectors, has = space.bundle(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        cosine = vectors @ self.vectors.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0)
        return [self.names[b] if h else "und" for b, h in zip(best, has)], np.where(has, score, 0.0)


def fit_prototypes(labelled: DataFrame, max_rows: int = MAX_ROWS, dims: int = DIMS, seed: int = 11) -> Prototypes:
    """Bundle ``text, lang`` rows per language; rows without text, letters or language teach nothing.

    About ``max_rows`` rows are used, chosen by a seeded hash of the text. Vectors are summed as fixed-point integers, so
    the prototypes do not depend on the order of the sums.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    part = min(1.0, max_rows / max(1, rows.count()))
    sample = rows.where(seeded(seed, F.col("text")) < part)

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, held = Space(seed, dims), {}
        for batch in batches:
            vectors, has = space.bundle(list(batch["text"]))
            fixed = np.rint(vectors * SCALE).astype(np.int64)
            for lang in set(batch["lang"][has]):
                mine = (batch["lang"] == lang).to_numpy() & has
                held[lang] = held.get(lang, 0) + fixed[mine].sum(axis=0)
        if held:
            yield pd.DataFrame({"lang": list(held), "sums": [v.tolist() for v in held.values()]})

    parts = sample.mapInPandas(bundle, "lang string, sums array<bigint>").select("lang", F.posexplode("sums").alias("dim", "part"))
    summed = parts.groupBy("lang", "dim").agg(F.sum("part").alias("total"))
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages times dimensions
        found.setdefault(r["lang"], np.zeros(dims))[r["dim"]] = r["total"]
    names = tuple(sorted(found))
    vectors = np.stack([found[n] / (np.linalg.norm(found[n]) or 1.0) for n in names]).astype(np.float32) if names else np.zeros((0, dims), np.float32)
    return Prototypes(names, vectors, seed)


def identify_language(docs: DataFrame, model: Prototypes, dims: int = DIMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text when nothing was learned; a tie goes
    to the first language by name. Null ids stay null, repeated rows are judged alike, other columns play no part.
    """
    small_batches(docs.sparkSession)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = Space(model.seed, dims)
        for batch in batches:
            names, score = model.predict(space, list(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(object), "lang_pred": names, "score": score.astype(float)})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(predict, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
