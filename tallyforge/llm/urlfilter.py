"""URL filter: logistic regression on hashed character n-grams of host and path.

Features are the 3- to 5-grams of the framed host and of the framed path (with the
query), hashed apart from each other into 2^16 places and scaled to length one.
The model is trained here, on the driver, from a small labelled table of URLs, by
full-batch gradient descent; it is 2^16 numbers whatever the corpus.

Defined results
* null URL: null score, not blocked; empty URL, or one without host and path: the model's intercept
* schemes, ports, user names and fragments are ignored; letters are compared in lower case
* repeated rows are scored alike; an empty table gives an empty result; very long URLs are read whole
* columns that clash with ``score`` and ``blocked`` push those to ``score_`` and ``blocked_``
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import U64, mix
from .shared import free_name

PLACES = 1 << 16
GRAMS = (3, 4, 5)
THRESHOLD = 0.5
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)")

#: Words of hosts that crawls block (gambling, pills, sex, loans and prizes, cracks, link farms, trackers), of ordinary hosts, and of both.
_BLOCKED = """casino poker roulette jackpot slots blackjack bingo betting bets bookmaker odds gambling lottery
viagra cialis pills pharmacy-rx meds-order weightloss steroids porn xxx sex adult escort nude webcam-girls milf erotic hookup
payday loans-fast giveaway prize-claim bitcoin-double hyip replica-watches fake-id get-rich warez crack keygen torrent-dl serialz
spam backlinks linkfarm seo-links doorway bulk-mail ads adserver adclick tracker track-pixel popup banner-click clicktrack""".split()
_ORDINARY = """garden library museum theatre university school college hospital clinic council weather railway timetable bakery recipes cooking kitchen
news journal magazine review novel poems history archive census statistics research physics biology geology astronomy chemistry maths geometry
hiking trails mountain alps river coast harbour sailing cycling bikes running football chess climbing camping wildlife birds otters trees roses plants
music piano orchestra choir photo painting pottery cinema film dance wiki forum docs guide manual compiler kernel software database python teacher lessons
language grammar dictionary travel hotel flights train ferry village town region parliament law court charity volunteer church market farmers paper pens
furniture clothes shoes toys books stories children parents health sleep doctor dentist pharmacy-school bank-history insurance energy solar winter spring summer autumn
haushalt wanderung bibliothek stadt schule garten kochen nachrichten wetter rathaus jardin cuisine montagne ecole musee livres recettes mairie voyage
escuela biblioteca cocina noticias jardines montes libros ciudad viajes tiempo brennick ondrelle vantessa kirandor marento lunara
castelmont harrowby milden bradwell ashmere ourelle denmoor lerantis wentholm reshtel anderholt sorrento withland oakhurst pellandra quorley stanmere""".split()
_BOTH = "best online free my top world 24 city club shop daily live new big pro hub zone point house cheap win track farm x link the home net one lucky star old royal fast hot".split()
_PATHS = "index page list about item view start help story post".split()


def _hosts(words: list[str], times: int, label: int) -> list[tuple[str, int]]:
    """Each word alone and beside ``times`` words that are in hosts of both kinds, so that these decide nothing."""
    out = []
    for i, word in enumerate(words):
        out.append((f"https://{word}.test/{_PATHS[i % len(_PATHS)]}", label))
        for j in range(times):
            other, dash = _BOTH[(5 * i + 11 * j) % len(_BOTH)], "-" if (i + j) % 2 else ""
            host = f"{other}{dash}{word}" if (i + j) % 3 else f"{word}{dash}{other}"
            out.append((f"https://{host}.test/{words[(i + 3 * j + 1) % len(words)] if j % 2 else _PATHS[(i + j) % len(_PATHS)]}/{7 * i + j}", label))
    return out


#: The labelled table: 1 is blocked.
LABELLED = _hosts(_BLOCKED, 5, 1) + _hosts(_ORDINARY, 4, 0)


def features(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the hashed n-grams of URLs; the values of a row have length one."""
    parts = [_URL.match(u.lower()).groups() for u in urls]
    rows, places = [], []
    for side, text in enumerate(zip(*parts)) if parts else []:
        raw = [f"^{x.removeprefix('www.') if side == 0 else x}$".encode() for x in text]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(U64)
        row = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        for n in GRAMS:
            if len(data) < n:
                continue
            m = len(data) - n + 1
            h = np.zeros(m, U64)
            for j in range(n):
                h = (h << U64(8)) | data[j : j + m]
            inside = row[:m] == row[n - 1 :]
            rows.append(row[:m][inside])
            places.append((mix(h[inside] * U64(16) + U64(2 * n + side)) % U64(PLACES)).astype(np.int64))
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    key, count = np.unique(np.concatenate(rows) * PLACES + np.concatenate(places), return_counts=True)
    row, place = key // PLACES, key % PLACES
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value**2, len(urls)))
    return row, place, value / norm[row]


class UrlModel:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def scores(self, urls: list[str | None]) -> np.ndarray:
        row, place, value = features([u or "" for u in urls])
        return 1 / (1 + np.exp(-(np.bincount(row, value * self.weights[place], len(urls)) + self.intercept)))


def varied(table: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Each URL also with the prefixes, languages and tracking words that pages of any kind have, so that these decide nothing."""
    out = []
    for url, label in table:
        scheme, _, rest = url.partition("://")
        host, _, path = rest.partition("/")
        bare = path.split("?")[0].split("#")[0]
        out += [(url, label), (f"{scheme}://m.{host}/{bare}?utm_source=feed", label), (f"{scheme}://blog.{host}/en/{bare}?page=2&ref=x", label), (f"{scheme}://www.{host}/fr/{bare}.html", label), (f"{scheme}://{host}/de/12/", label), (f"{scheme}://{host}/es/7#top", label)]
    return out


def train(table: list[tuple[str, int]] = LABELLED, steps: int = 400, rate: float = 8.0, penalty: float = 1e-4) -> UrlModel:
    """Logistic regression with a small squared penalty; either label has half of the weight; deterministic."""
    table = varied(table)
    row, place, value = features([u for u, _ in table])
    y = np.array([label for _, label in table], float)
    share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    w, b = np.zeros(PLACES), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * w[place], len(y)) + b)))
        error = (p - y) * share
        w -= rate * (np.bincount(place, value * error[row], PLACES) + penalty * w)
        b -= rate * error.sum()
    return UrlModel(w, b)


def scored(df: DataFrame, model: UrlModel | None = None, url_col: str = "url", columns: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of ``df`` (all by default) with ``score`` and ``blocked``."""
    model = model or train()
    kept = df.columns if columns is None else columns
    names = [free_name(kept, "score"), free_name(kept, "blocked")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(len(kept))
            score = model.scores(urls.to_pylist())
            null = urls.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(np.round(score, 6), mask=null), pa.array((score >= threshold) & ~null)], names=schema.names)

    source = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{url_col}`").cast("string").alias("url_"))
    return source.mapInArrow(run, schema)
