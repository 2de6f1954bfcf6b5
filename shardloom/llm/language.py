"""Language ID by nearest centroid: TF-IDF vectors of byte n-grams against several centroids per language, by cosine.

N-grams of one to three UTF-8 bytes of the lower-cased text, with everything in ASCII but letters folded into blanks, are
hashed to ``WIDTH`` columns; logarithmic counts are weighted and normalised. The model is fitted on a bounded sample, at
most ``SAMPLE_DOCS`` labelled texts of each of the ``MOST_LANGS`` most frequent languages, chosen by a hash of the text
and none over ``SAMPLE_BYTES``; it is a small table of centroids. Each language's vectors are clustered into
at most ``CENTROIDS`` groups of ``LEAST_MEMBERS`` or more, and a language keeps a low quantile of its members' cosines.
Prediction reads the whole text of every document, in pieces if it is long, and shuffles nothing.

A document is rejected if it has no letters, or if its cosine is less than ``SLACK`` times the ``LOW`` quantile of the
cosines of its language's training texts: it is then much farther than nearly all that the language was learned from. A
language of fewer than ``LEAST_MEMBERS`` texts tells no distance of its own and takes the least of the other languages;
if there is none, it rejects nothing for its distance. Texts of fewer than ``FEW_GRAMS`` n-grams lie far from everything
by their length alone and are not rejected for it.

Null or odd input: a null, empty or letterless text is ``und`` with score 0; texts without a label, or with a null id
where the split needs one, are not learned from; repeated rows are predicted alike; without any labelled text every
document is ``und``. Further columns are kept; ``lang_pred``, ``score`` and ``rejected`` are replaced if already there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from shardloom.llm import workers
from shardloom.llm.registry import query, table
from shardloom.llm.textscan import CHUNK_BYTES, LOWER, chunks, text_bytes

WIDTH = 8192
CENTROIDS = 3
#: Texts behind a centroid; a smaller cluster is made of outliers.
LEAST_MEMBERS = 10
#: Quantile of a language's own cosines from which the rejection distance is taken.
LOW = 0.02
SAMPLE_DOCS = 300
MOST_LANGS = 200
SAMPLE_BYTES = 100_000
SLACK = 0.25
FEW_GRAMS = 150
UNKNOWN = "und"

_FOLD = LOWER.astype(np.int64)
_FOLD[:128] = [b if chr(b).isalpha() else 32 for b in LOWER[:128].tolist()]
_CHUNK = CHUNK_BYTES // 2
#: Texts whose counts are held at once.
ROWS = 128


def _gram_columns(data: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n-grams that start at each byte with n bytes left."""
    key = np.full(max(0, len(data) - n + 1), n, dtype=np.int64)
    for k in range(n):
        key = (key * 769 + data[k : k + len(key)]) & 0xFFFFFFFF
    return ((key * 2654435761) & 0xFFFFFFFF) >> (32 - WIDTH.bit_length() + 1)


def gram_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed n-grams, one row per text; texts are read whole, in slices of bounded size."""
    data, offsets = text_bytes(column)
    counts = np.zeros((len(column), WIDTH), dtype=np.float32)
    for at in range(0, len(data), _CHUNK):
        piece = _FOLD[data[at : at + _CHUNK + 2]]
        first, last = np.searchsorted(offsets, [at, min(at + _CHUNK, len(data)) - 1], "right") - 1
        row = np.repeat(np.arange(first, last + 1), np.diff(np.clip(offsets[first : last + 2], at, at + len(piece))))
        row = np.append(row, np.full(len(piece) - len(row), last + 1))  # the two bytes beyond may be of later rows
        for n in (1, 2, 3):
            columns = _gram_columns(piece, n)[:_CHUNK]
            starts = row[: len(columns)]
            end = offsets[np.minimum(starts, len(column) - 1) + 1] - at
            inside = (np.arange(len(columns)) + n <= end) & (starts <= last)
            cells = (starts[inside] - first) * WIDTH + columns[inside]
            counts[first : last + 1] += np.bincount(cells, minlength=(last - first + 1) * WIDTH).reshape(-1, WIDTH).astype(np.float32)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its cosine and whether the text lies too far off."""
        cosines = weighted(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0).astype(np.float64)
        return self.owner[best], score, (score < SLACK * self.least[best]) & (counts.sum(axis=1) >= FEW_GRAMS)


def _cluster(vectors: np.ndarray, k: int, rounds: int = 15, tries: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and the centroid of each vector: farthest-first starts, then spherical k-means.

    Clusters of fewer than ``LEAST_MEMBERS`` are started anew without their members, then there is one cluster less.
    """
    starts = np.ones(len(vectors), dtype=bool)
    for size in range(k, 0, -1):
        for _ in range(tries):
            centroids, member = _k_means(vectors, vectors[starts], size, rounds)
            counts = np.bincount(member, minlength=len(centroids))
            few = (counts > 0) & (counts < LEAST_MEMBERS)
            if not few.any() or (counts > 0).sum() == 1:
                return centroids, member
            starts &= ~few[member]
            if not starts.any():
                starts[:] = True
                break
    return centroids, member


def _k_means(vectors: np.ndarray, starts: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    centroids = starts.mean(axis=0, keepdims=True)
    centroids = centroids / max(float(np.linalg.norm(centroids)), 1e-12)
    while len(centroids) < min(k, len(starts)):
        centroids = np.vstack([centroids, starts[(starts @ centroids.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        member = (vectors @ centroids.T).argmax(axis=1)
        for c in np.unique(member):
            mean = vectors[member == c].mean(axis=0)
            centroids[c] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model of the languages of the labelled rows; only texts with letters and a language are used."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & has_letters(F.col("text")) & (F.octet_length("text") <= SAMPLE_BYTES)
    )
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).select("lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    sample = rows.join(F.broadcast(langs), "lang").withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS)
    found = sample.select("lang", "text").orderBy("lang", "rank").toArrow().combine_chunks()  # bounded by the limits above
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    if not len(names):
        return Model([], np.ones(WIDTH, np.float32), np.zeros((0, WIDTH), np.float32), np.zeros(0, int), np.zeros(0))
    batches = [gram_counts(part.column("text")) for b in found.to_batches() for part in chunks(b, "text")]
    counts = np.concatenate(batches)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.05).astype(np.float32)
    vectors = weighted(counts, idf)
    languages = sorted(set(names))
    centroids, owner, low = [], [], []
    for k, name in enumerate(languages):
        mine = vectors[names == name]
        centres, member = _cluster(mine, CENTROIDS)
        for c in np.unique(member):
            centroids.append(centres[c])
            owner.append(k)
        own = np.einsum("ij,ij->i", mine, centres[member])
        low.append(float(np.quantile(own, LOW)) if len(mine) >= LEAST_MEMBERS else np.nan)
    known = [x for x in low if not np.isnan(x)]
    low = np.nan_to_num(np.array(low), nan=min(known, default=0.0))
    return Model(languages, idf, np.stack(centroids), np.array(owner), low[owner])


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``."""
    workers.small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    # Plain arrays: workers need not have this package. At most MOST_LANGS * CENTROIDS rows of WIDTH numbers.
    fitted = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.centroids, model.owner, model.least))
    fields, columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), docs.columns
    # The rows go along as structs, so that no column of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"), has_letters(F.col(f"`{text}`")).alias("letters"))

    def run(batches):
        m = Model(*fitted.value)
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                n = part.num_rows
                known = part.column("letters").to_numpy(zero_copy_only=False) & bool(m.languages)
                names, scores, far = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
                for at in range(0, n, ROWS) if m.languages else ():
                    rows = slice(at, min(n, at + ROWS))
                    lang, score, off = m.predict(gram_counts(part.column("text").slice(at, ROWS)))
                    names[rows], scores[rows], far[rows] = np.array(m.languages, dtype=object)[lang], score, off
                names[~known], scores[~known], far[~known] = UNKNOWN, 0.0, True
                yield pa.RecordBatch.from_arrays(
                    [*(part.column("row").field(c) for c in columns), pa.array(names, pa.string()), pa.array(scores), pa.array(far)],
                    [*columns, "lang_pred", "score", "rejected"],
                )

    return rows.mapInArrow(workers.batches(run), f"{fields}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
