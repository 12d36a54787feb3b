"""Languages of documents and of the stretches of mixed ones (problem 1).

A multinomial naive Bayes model over hashed character n-grams is fitted on a
bounded sample of labelled rows; its matrix of log-probabilities is broadcast.
Sentence units are scored in batches: the n-grams of all units of a batch are
hashed at once with numpy and their rows of the matrix summed by unit. The most
likely sequence of languages over the units of a document, with a price for each
change, gives its segments.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sentences import PLAIN, units
from .tables import read, spread

#: Hash buckets of n-grams; with as many rows and a column a language the matrix is bounded.
BUCKETS = 1 << 16
#: Lengths of the n-grams.
GRAMS = (1, 2, 3, 4)
#: Labelled rows a language that the model is fitted on, at most about so many from each table.
FIT_ROWS = 600
#: Log-odds that a change of language within a document costs.
CHANGE = 7.0
#: Weight that the summed log-probabilities of overlapping n-grams get in posteriors.
TEMPER = 0.25

#: Scripts that a language may be written in, by the names in ``lang_codes``.
SCRIPTS = ("LATIN", "DEVANAGARI", "CJK", "HIRAGANA", "KATAKANA", "THAI", "CYRILLIC", "GREEK", "ARABIC", "OTHER")
OF_SCRIPT = {"Latin": ["LATIN"], "Devanagari": ["DEVANAGARI"], "Han": ["CJK"], "Japanese": ["HIRAGANA", "KATAKANA", "CJK"], "Thai": ["THAI"]}
#: Characters that each language has of its script before anything is counted.
PRIOR = 300.0


def _classes() -> np.ndarray:
    """For each code point of the BMP: 0 for what separates words, else 1 + index of its script."""
    out = np.full(65536, 1 + SCRIPTS.index("OTHER"), np.uint8)
    for c in range(65536):
        kind = unicodedata.category(chr(c))
        if kind[0] not in "LM":
            out[c] = 0
            continue
        name = unicodedata.name(chr(c), "")
        for i, s in enumerate(SCRIPTS):
            if name.startswith(s):
                out[c] = 1 + i
                break
    return out


_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _classes()
    return _CLASSES


_PLAIN: tuple[np.ndarray, np.ndarray] | None = None


def _plain() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the BMP the one that it counts as, and whether it counts at all."""
    global _PLAIN
    if _PLAIN is None:
        as_, stays = np.arange(65536), np.ones(65536, bool)
        for c, x in PLAIN.items():
            if x is None:
                stays[c] = False
            else:
                as_[c] = x if isinstance(x, int) else ord(x)
        _PLAIN = as_, stays
    return _PLAIN


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with separators as blanks, their script (0: none) and the text each belongs to."""
    joined = "\n".join(texts)
    if not joined.isascii():
        joined = unicodedata.normalize("NFKC", joined)
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    # A line break inside a text separates words like any blank.
    inner = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
    owner = inner[np.concatenate([[0], np.cumsum(codes == 10)[:-1]])] if len(codes) else np.zeros(0, np.int64)
    as_, stays = _plain()
    low = np.minimum(codes, 65535)
    keep = stays[low]
    codes, owner = np.where(codes < 65536, as_[low], codes)[keep], owner[keep]
    kind = np.where(codes < 65536, classes()[np.minimum(codes, 65535)], 1 + SCRIPTS.index("OTHER"))
    return np.where(kind == 0, 32, codes), kind, owner


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, and the text each belongs to; the first buckets are scripts."""
    codes, kind, owner = _codes(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = kind == 0
    # Runs of separators count once.
    keep = ~(gap & np.concatenate([[False], gap[:-1] & (owner[1:] == owner[:-1])]))
    codes, owner, kind, gap = codes[keep], owner[keep], kind[keep], gap[keep]
    found, whose = [kind[~gap].astype(np.int64) - 1], [owner[~gap]]
    state = np.zeros(len(codes), np.uint64)
    room = BUCKETS - len(SCRIPTS)
    for n in range(1, max(GRAMS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        state = state[:size] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :].astype(np.uint64) + np.uint64(n)
        if n not in GRAMS:
            continue
        whole = owner[:size] == owner[n - 1 :]
        if n == 1:
            whole &= ~gap
        mixed = (state[whole] ^ (state[whole] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((mixed >> np.uint64(20)).astype(np.int64) % room + len(SCRIPTS))
        whose.append(owner[:size][whole])
    return np.concatenate(found), np.concatenate(whose)


def script_counts(bucket: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Letters of each script (columns) in each text (rows), from the features of the texts."""
    of = bucket < len(SCRIPTS)
    return np.bincount(owner[of] * len(SCRIPTS) + bucket[of], minlength=count * len(SCRIPTS)).reshape(count, -1)


@dataclass
class Model:
    """Columns of ``logp`` are classes: a language in its own script, or in another one."""

    langs: list[str]
    logp: np.ndarray  # BUCKETS x classes
    of: np.ndarray  # language of each class

    def classes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text (rows) in each class, and its letters by script; a slice of the texts at a time."""
        out = np.zeros((len(texts), len(self.of)), np.float32)
        letters = np.zeros((len(texts), len(SCRIPTS)), np.int64)
        sizes = np.cumsum([len(t) for t in texts])
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + 100_000)))
            bucket, owner = features(texts[i:j])
            letters[i:j] = script_counts(bucket, owner, j - i)
            order = np.argsort(owner, kind="stable")
            bucket, owner = bucket[order], owner[order]
            if len(owner):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[i + owner[first]] = np.add.reduceat(self.logp[bucket], first, axis=0)
            i = j
        return out, letters

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood in each language; a few Latin letters alone (numerals, marks) are no evidence."""
        by_class, letters = self.classes(texts)
        out = np.full((len(texts), len(self.langs)), -1e9, np.float32)
        for c, lang in enumerate(self.of):
            out[:, lang] = np.maximum(out[:, lang], by_class[:, c])
        out[(letters.sum(axis=1) == letters[:, 0]) & (letters[:, 0] < 5)] = 0
        return out


def path(score: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """Most likely language of each unit of one document."""
    n, k = score.shape
    if n <= 1:
        return score.argmax(axis=1)
    # One odd unit gives at most so much evidence that its neighbours can't outweigh it.
    score = score * TEMPER
    best, back = score[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        moved = best[top] - change
        stay = best >= moved
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, moved) + score[i]
    out = np.zeros(n, np.int64)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _cut(rows: DataFrame) -> DataFrame:
    """The sentence units of the rows (text, lang), some in a row: a list of texts and their label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"units": [[t[a:b] for a, b in units(t)] for t in batch["text"]], "lang": batch["lang"]})

    return rows.mapInPandas(run, "units array<string>, lang string")


def _count(rows: DataFrame, langs: list[str], native: np.ndarray, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts by bucket and class, and units by the class that wins them and the label of their row.

    Without a model every unit counts for its row's label; with one, only units that it gives this label.
    """
    number = {x: i for i, x in enumerate(langs)}
    held = rows.sparkSession.sparkContext.broadcast(model)
    width = 2 * len(langs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BUCKETS, width), np.int64)
        won = np.zeros((width, len(langs)), np.int64)
        m: Model | None = held.value
        for batch in batches:
            texts = [u for own in batch["units"] for u in own]
            label = np.repeat([number[x] for x in batch["lang"]], [len(own) for own in batch["units"]]).astype(np.int64)
            for i in range(0, len(texts), 2000):
                some, of = texts[i : i + 2000], label[i : i + 2000]
                bucket, owner = features(some)
                letters = script_counts(bucket, owner, len(some))
                column = 2 * of + ~native[of, letters.argmax(axis=1)]
                ok = np.ones(len(some), bool)
                if m is not None:
                    best = m.classes(some)[0].argmax(axis=1)
                    np.add.at(won, (best, of), 1)
                    ok = m.of[best] == of
                counted = ok[owner]
                total += np.bincount(bucket[counted] * width + column[owner[counted]], minlength=total.size).reshape(total.shape)
        used = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"bucket": used} | {f"n{i}": total[used, i] for i in range(width)})
        extra = np.zeros((width, width), np.int64)
        extra[:, : len(langs)] = won
        yield pd.DataFrame({"bucket": BUCKETS + np.arange(width)} | {f"n{i}": extra[:, i] for i in range(width)})

    schema = "bucket bigint, " + ", ".join(f"n{i} bigint" for i in range(width))
    sums = rows.mapInPandas(run, schema).groupBy("bucket").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(width)))
    got = sums.toPandas()  # at most BUCKETS rows and one a class
    out = np.zeros((BUCKETS + width, width), np.float64)
    out[got["bucket"].to_numpy()] = got.drop(columns="bucket").to_numpy(np.float64)
    return out[:BUCKETS], out[BUCKETS:, : len(langs)]


def fit(labelled: DataFrame, codes: DataFrame) -> Model:
    """Model of the languages in ``codes`` from ``labelled`` (text, lang).

    Of each language about ``FIT_ROWS`` rows are used, picked by a hash. Labels
    may be wrong: after the first round only units count that the model of the
    round before gives their row's label, and a class of a language in another
    script stays only if most units that it wins bear this language's label.
    """
    of = {r["lang"]: r["script"] for r in codes.select("lang", "script").collect()}
    langs = sorted(of)
    native = np.array([[s in OF_SCRIPT.get(of[x], ["OTHER"]) for s in SCRIPTS] for x in langs])
    rows = labelled.where(F.col("lang").isin(langs) & F.col("text").isNotNull()).select("text", "lang")
    share = {r["lang"]: min(1.0, FIT_ROWS / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if share:
        limit = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
        rows = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_003)) < limit * 1_000_003)
    rows = _cut(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)).cache()
    model, alive = None, np.ones(2 * len(langs), bool)
    for _ in range(3):
        counts, won = _count(rows, langs, native, model)
        if model is not None:
            own = won[np.arange(len(won)), np.arange(len(won)) // 2]
            alive &= (np.arange(len(won)) % 2 == 0) | (own > 0.5 * np.maximum(won.sum(axis=1), 1))
        alive &= (np.arange(len(alive)) % 2 == 0) | (counts.sum(axis=0) > 0)
        for i in range(len(langs)):
            counts[: len(SCRIPTS), 2 * i] += PRIOR * native[i]
        smooth = counts + 0.5
        logp = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        model = Model(langs, np.where(alive, logp, np.float32(-1e4)), np.arange(len(alive)) // 2)
    rows.unpersist()
    return Model(langs, model.logp[:, alive], model.of[alive])


def plain_label(label: F.Column) -> F.Column:
    """A label without case, outer blanks and region."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"^\s+|\s+$", ""))), r"[-_].*$", "")


def labels(requests: DataFrame, codes: DataFrame) -> DataFrame:
    """document_id and the language that its latest request names, null if it names none.

    Requests without a time count as the earliest; of equal times the highest id wins.
    """
    latest = requests.groupBy("document_id").agg(F.max_by("language", F.struct("requested_at", "request_id")).alias("label"))
    names = codes.select(
        F.col("lang").alias("named"), F.explode(F.array(*(F.lower(F.trim(c)) for c in ("lang", "code3", "name_en")))).alias("name")
    ).dropDuplicates(["name"])
    return latest.join(F.broadcast(names), plain_label(F.col("label")) == F.col("name"), "left").select("document_id", "named")


PAGE_MARK = r"^\s*Page\s+\d+\s*$"


def segments(docs: DataFrame, model: Model, key: str = "document_id", text: str = "content", scanned: str | None = "ocr_used") -> DataFrame:
    """One row a segment: key, segment (from 0), start_char, end_char, lang, confidence.

    Texts without sentences have no rows. In scanned documents page marks belong
    to no segment and the first one begins after the first mark.
    """
    import re

    held = docs.sparkSession.sparkContext.broadcast(model)
    flag = F.coalesce(F.col(scanned), F.lit(False)) if scanned else F.lit(False)
    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), flag.alias("scanned")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = re.compile(PAGE_MARK)
        first_mark = re.compile(r"^[ \t]*##[ \t]*Page[ \t]+\d+[ \t]*(?:\r\n|\r|\n)", re.M)
        m = held.value
        for batch in batches:
            keys, texts, marks = (batch.column(i).to_pylist() for i in range(3))
            spans, pieces, bounds = [], [], [0]
            for t, scan in zip(texts, marks):
                own = [x for x in units(t) if not (scan and mark.match(t[x[0] : x[1]]))]
                spans.append(own)
                pieces += [t[a:b] for a, b in own]
                bounds.append(len(pieces))
            score = m.score(pieces)
            out: list[list] = [[] for _ in range(6)]
            for i, own in enumerate(spans):
                if not own:
                    continue
                part = score[bounds[i] : bounds[i + 1]]
                way = path(part)
                cuts = [0, *(np.flatnonzero(way[1:] != way[:-1]) + 1), len(way)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    summed = part[a:b].sum(axis=0) * TEMPER
                    odds = np.exp(summed - summed.max())
                    start = own[a][0]
                    if n == 0 and marks[i] and (x := first_mark.search(texts[i])):
                        start = x.end()
                    for col, v in zip(out, (keys[i], n, start, own[b - 1][1], m.langs[way[a]], float(odds[way[a]] / odds.sum()))):
                        col.append(v)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["key", "segment", "start_char", "end_char", "lang", "confidence"])

    schema = "key string, segment int, start_char bigint, end_char bigint, lang string, confidence double"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


#: Models by application and folder, so that all queries of an application share one fit.
_FITTED: dict[tuple[str, str], Model] = {}


def model_for(spark: SparkSession, sf_dir: str) -> Model:
    """Model from the declared languages of documents and the labels of parsed documents, fitted once an application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _FITTED:
        _FITTED[at] = _model(spark, sf_dir)
    return _FITTED[at]


def _model(spark: SparkSession, sf_dir: str) -> Model:
    codes = read(spark, sf_dir, "lang_codes")
    named = labels(read(spark, sf_dir, "parse_requests"), codes)
    parsed = read(spark, sf_dir, "parsed_documents").where(~F.col("ocr_used")).join(named, "document_id")
    own = parsed.select(F.col("content").alias("text"), F.col("named").alias("lang"))
    return fit(own.unionByName(read(spark, sf_dir, "documents").select("text", "lang")), codes)


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every parsed document with language and confidence."""
    return segments(read(spark, sf_dir, "parsed_documents"), model_for(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the documents in several languages or whose label doesn't name their language."""
    named = labels(read(spark, sf_dir, "parse_requests"), read(spark, sf_dir, "lang_codes"))
    parts = p1_segments(spark, sf_dir)
    each = F.struct("start_char", "lang")
    docs = parts.groupBy("document_id").agg(F.collect_list(each).alias("parts"))
    cases = docs.join(named, "document_id", "left").where(
        (F.size("parts") > 1) | ~F.coalesce(F.col("parts")[0]["lang"] == F.col("named"), F.lit(False))
    )
    return cases.select("document_id", F.inline("parts")).select("document_id", "start_char", "lang")
