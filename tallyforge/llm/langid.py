"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter n-gram is the product of
its letters' vectors, each permuted (rotated) by its distance from the n-gram's
end; a text is the sum of its n-grams, a language the sum of its sample texts.
The answer is the language whose prototype has the largest cosine to the text.

The cosine that accepts a text depends on how many n-grams it rests on.  A text
whose n-grams occur c times each is worth (sum c)^2 / (sum c^2) of them: its cosine
is the mean weight of its n-grams in the prototype times the root of that number,
so a short or repetitive text of a language has a small cosine and a varied one
does not.  Training holds out each half of the labelled sample in turn, cuts
passages of 1, 2, 4 ... 512 words and whole texts from it, and takes for each power
of two of that number ``MARGIN`` times the cosine that all but ``REJECTED`` of them
reach; between the middles of these classes it is interpolated.  A repetitive text is
thus judged as leniently as a short one.

Defined results
* null text, or a text without letters: language null, cosine 0, rejected
* a cosine below the calibrated one, or below ``min_cosine``, for every language: the best language is named, but the text is rejected
* too few labelled passages to calibrate a number of n-grams: what holds for fewer n-grams holds there, ``min_cosine`` alone if there is none
* equal cosines: the alphabetically first language
* very long texts are read whole; the work grows with their distinct n-grams
* repeated rows are judged alike; an empty table gives an empty result
* ``columns`` that clash with the three added ones: the added ones get underscores
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .shared import arrow_map, free_name

DIMENSIONS = 1024
GRAM = 3
#: Labelled sample for the prototypes: this many texts of each language, those with the smallest hashed ids.
SAMPLE_PER_LANGUAGE = 400
#: Random vectors of DIMENSIONS entries have cosines of about 1/32; below twice that nothing was recognised, however short the text.
MIN_COSINE = 2 / np.sqrt(DIMENSIONS)
#: Share of held-out passages that the calibrated cosine may reject, and passages that a class must have to be calibrated.
REJECTED, LEAST_PASSAGES = 0.005, 40
#: Texts of a taught language from elsewhere than the labelled ones reach less than those do.
MARGIN = 0.6
#: Words of the held-out passages, besides whole texts, and classes of worth: powers of two of n-grams.
PASSAGE_WORDS = [1 << i for i in range(10)]
CLASSES = 12
SEED = 20_011
#: Bytes of text that share one table of n-gram vectors.
SLICE_BYTES = 1 << 19


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=4096)
def _letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dimensions, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def gram_vectors(codes: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Bound vectors of n-grams: rows of ``codes`` are the code points of one n-gram."""
    alphabet, place = np.unique(codes, return_inverse=True)
    place = place.reshape(codes.shape)
    base = np.stack([_letter_vector(int(c), dimensions, seed) for c in alphabet])
    n = codes.shape[1]
    out = np.ones((len(codes), dimensions), np.int8)
    for j in range(n):
        out *= np.roll(base, n - 1 - j, axis=1)[place[:, j]]
    return out


class _Grams:
    """Distinct n-grams of a batch of texts with a count matrix (texts x n-grams)."""

    def __init__(self, texts: list[str | None], n: int):
        # Words are separated by one space; a text is framed by spaces.
        framed = [" " + t.lower() + " " if t else " " for t in texts]
        points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(framed)), [len(t) for t in framed])
        points = np.where(_letters()[points], points, np.uint32(32))
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32) | (doc[1:] != doc[:-1])
        points, doc = points[keep], doc[keep]
        self.docs = len(texts)
        if len(points) < n:
            self.codes, self.counts = np.zeros((0, n), np.uint32), np.zeros((self.docs, 0), np.float32)
            return
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        alphabet = np.flatnonzero(seen)
        number = np.zeros(0x110000, np.int64)
        number[alphabet] = np.arange(len(alphabet))
        letter = number[points]
        m = len(points) - n + 1
        gram = np.zeros(m, np.int64)
        blank = np.ones(m, bool)
        for j in range(n):
            gram = gram * len(alphabet) + letter[j : j + m]
            blank &= points[j : j + m] == 32
        inside = (doc[:m] == doc[n - 1 : n - 1 + m]) & ~blank
        gram, doc = gram[inside], doc[:m][inside]
        if len(alphabet) ** n <= 1 << 22:
            hit = np.zeros(len(alphabet) ** n, bool)
            hit[gram] = True
            distinct = np.flatnonzero(hit)
            where = np.zeros(len(hit), np.int32)
            where[distinct] = np.arange(len(distinct))
            column = where[gram]
        else:
            distinct, column = np.unique(gram, return_inverse=True)
        left, points_of = distinct.copy(), []
        for _ in range(n):
            points_of.append(alphabet[left % len(alphabet)])
            left //= len(alphabet)
        self.codes = np.stack(points_of[::-1], axis=1).astype(np.uint32)
        self.doc, self.column = doc, column

    def blocks(self, width: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first text, count matrix) for runs of texts; a matrix has about ``width`` cells."""
        if not len(self.codes):
            yield 0, np.zeros((self.docs, 0), np.float32)
            return
        u = len(self.codes)
        rows = max(1, width // u)
        edges = np.searchsorted(self.doc, np.arange(0, self.docs + rows, rows))
        for k in range(len(edges) - 1):
            first = k * rows
            size = min(rows, self.docs - first)
            part = slice(edges[k], edges[k + 1])
            flat = np.bincount((self.doc[part] - first) * u + self.column[part], minlength=size * u)
            yield first, flat.reshape(size, u).astype(np.float32)


class Profiles:
    """Language prototypes, small enough to travel with the tasks: languages x dimensions."""

    def __init__(self, languages: list[str], prototypes: np.ndarray, n: int, dimensions: int, seed: int):
        self.languages, self.prototypes, self.n, self.dimensions, self.seed = languages, prototypes, n, dimensions, seed
        self._known: dict[bytes, np.ndarray] = {}
        #: for each class of worth the cosine that accepts, 0 where nothing was calibrated
        self.floors = np.zeros(CLASSES)

    @classmethod
    def train(cls, samples: dict[str, list[str]], n: int = GRAM, dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
        names = sorted(samples)
        vectors = np.zeros((len(names), dimensions), np.float32)
        for i, name in enumerate(names):
            for first in range(0, len(samples[name]), 100):
                g = _Grams(samples[name][first : first + 100], n)
                total = sum((block.sum(axis=0) for _, block in g.blocks()), np.zeros(len(g.codes), np.float32))
                if len(g.codes):
                    vectors[i] += total @ gram_vectors(g.codes, dimensions, seed).astype(np.float32)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return cls(names, vectors / np.where(norms == 0, 1, norms), n, dimensions, seed)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def cosines(self, texts: list[str | None]) -> np.ndarray:
        """texts x languages; a row of zeros for a text without n-grams."""
        return self.judged(texts)[0]

    def judged(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, how many n-grams each text is worth)."""
        g = _Grams(texts, self.n)
        out, worth = np.zeros((len(texts), len(self.languages)), np.float32), np.zeros(len(texts))
        if not len(g.codes) or not self.languages:
            return out, worth
        table = gram_vectors(g.codes, self.dimensions, self.seed).astype(np.float32)
        for first, counts in g.blocks():
            vectors = counts @ table
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            out[first : first + len(counts)] = (vectors / np.where(norms == 0, 1, norms)) @ self.prototypes.T
            # Sums of squares of long texts exceed what float32 counts exactly.
            squares = np.einsum("ij,ij->i", counts, counts, dtype=np.float64)
            worth[first : first + len(counts)] = counts.sum(axis=1, dtype=np.float64) ** 2 / np.where(squares == 0, 1, squares)
        return out, worth

    def least(self, worth: np.ndarray) -> np.ndarray:
        """The calibrated cosine that accepts texts worth so many n-grams."""
        return np.interp(np.log2(np.maximum(worth, 1)), np.arange(CLASSES) + 0.5, self.floors)

    def calibrate(self, samples: dict[str, list[str]]) -> None:
        """Sets ``floors`` from the samples, each half judged by prototypes of the other."""
        worth, own = [np.zeros(0)], [np.zeros(0)]
        for half in (0, 1):
            taught = Profiles.train({k: v[1 - half :: 2] for k, v in samples.items()}, self.n, self.dimensions, self.seed)
            for i, name in enumerate(taught.languages):
                cut = [p for k, t in enumerate(samples[name][half::2]) for p in passages(t, k)]
                for first in range(0, len(cut), 200):
                    cosines, n = taught.judged(cut[first : first + 200])
                    worth.append(n)
                    own.append(cosines[:, i].astype(np.float64))
        worth, own = np.concatenate(worth), np.concatenate(own)
        kind, floor = _class(worth), 0.0
        for c in range(CLASSES):
            mine = own[(kind == c) & (worth > 0)]
            if len(mine) >= LEAST_PASSAGES:
                floor = max(floor, MARGIN * float(np.quantile(mine, REJECTED)))
            self.floors[c] = floor


def _class(worth: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(worth, 1)).astype(int), 0, CLASSES - 1)


def passages(text: str, k: int) -> Iterator[str]:
    """The text, and of each length in PASSAGE_WORDS below its own a passage from a place that depends on ``k``."""
    words = text.split()
    yield text
    for size in PASSAGE_WORDS:
        if size < len(words):
            at = k * 7919 % (len(words) - size + 1)
            yield " ".join(words[at : at + size])


def train_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Prototypes from at most ``per_language`` labelled texts of each language.

    The sample is the rows with the smallest hash of their id; ids and labels are
    ranked without the texts, which are then read for those ids alone.
    """
    by_hash = Window.partitionBy("language").orderBy("order", "id")
    named = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{language_col}`").alias("language"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)).alias("order")).where("id is not null and language is not null")
    chosen = named.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= per_language).select("id", "language")
    # At most per_language ids of each language, so the broadcast side is bounded by a parameter.
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id").where("text is not null").orderBy("id", "text").collect()
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r["language"], []).append(r["text"])
    profiles = Profiles.train(samples, dimensions=dimensions, seed=seed)
    profiles.calibrate(samples)
    return profiles


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", columns: list[str] | None = None, min_cosine: float = MIN_COSINE, accepted_only: bool = False) -> DataFrame:
    """``columns`` of ``df`` (all by default) with ``language``, ``cosine`` and ``accepted``; with ``accepted_only`` the accepted rows, nothing added."""
    kept = df.columns if columns is None else columns
    added: list[str] = []
    for wanted in ("language", "cosine", "accepted"):
        added.append(free_name([*kept, *added], wanted))
    schema = T.StructType([*(df.schema[c] for c in kept), *([] if accepted_only else [T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])])
    inner = free_name(kept, "text_")
    names = [f"c{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, inner, SLICE_BYTES):
                texts = part.column(part.schema.get_field_index(inner)).to_pylist()
                cosines, worth = profiles.judged(texts)
                cosines = cosines.astype(np.float64)
                some = (cosines != 0).any(axis=1) if len(profiles.languages) else np.zeros(len(texts), bool)
                best = cosines.argmax(axis=1) if len(profiles.languages) else np.zeros(len(texts), int)
                top = np.where(some, cosines[np.arange(len(texts)), best] if len(profiles.languages) else 0.0, 0.0)
                accepted = some & (top >= np.maximum(min_cosine, profiles.least(worth)))
                columns_out = [part.column(i) for i in range(len(kept))]
                if accepted_only:
                    yield pa.RecordBatch.from_arrays(columns_out, names=schema.names).filter(pa.array(accepted))
                else:
                    language = pa.array([profiles.languages[b] if s else None for b, s in zip(best, some)], pa.string())
                    yield pa.RecordBatch.from_arrays([*columns_out, language, pa.array(np.round(top, 6)), pa.array(accepted)], names=schema.names)

    source = df.select(*(F.col(f"`{c}`").alias(names[i]) for i, c in enumerate(kept)), F.col(f"`{text_col}`").alias(inner))
    return arrow_map(source, run, schema)
