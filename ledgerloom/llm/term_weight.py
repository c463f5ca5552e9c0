"""How distinctive a term is for a record (problem 5).

Two-Poisson mixture: the number of occurrences of a term in a record is drawn from one of two Poisson distributions, that of the
records that are about the term (elite) or that of the others. Rates and share are fitted for each term by
expectation-maximisation on the histogram of its counts over all records, zero included; a count's
score is the posterior probability of the elite component. The elite are a minority: their share is kept at one half or less, so that
a term of most records marks none of them.

Each record is counted where it is read. Only terms that are a key of some record are kept: while they are at most ``most_terms`` of ``most_bytes``
the set is handed to the counting tasks, beyond that all words are counted and joined with the terms. Histograms are
built with partial aggregation, so a term in every record is a few rows a task; a histogram has one entry for each distinct count.

Defined cases: terms are lower-cased without surrounding white space; null and empty terms are skipped; a repeated
term of a record, and a repeated row of an id, count once; null or empty content has no words; a term without any
occurrence has score 0; null ids are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import norm
from ledgerloom.llm.text import words
from ledgerloom.session import spread

_ROWS = pa.schema([("id", pa.string()), ("term", pa.string()), ("tf", pa.int64()), ("held", pa.int32())])
_MODEL = pa.schema([("term", pa.string()), ("df", pa.int64()), ("log_odds", pa.float64()), ("log_ratio", pa.float64()), ("rate_gap", pa.float64())])


def fit(term: np.ndarray, count: np.ndarray, freq: np.ndarray, n_terms: int, n_records: int, steps: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of the elite component, its rate and the other rate for each term, from histogram entries (term number, count >= 1, records)."""
    add = lambda w: np.bincount(term_, weights=w, minlength=n_terms)
    none = np.maximum(n_records - np.bincount(term, weights=freq, minlength=n_terms), 0)
    term_ = np.concatenate([term, np.arange(n_terms)])
    k = np.concatenate([count, np.zeros(n_terms)]).astype(float)
    f = np.concatenate([freq, none]).astype(float)
    total = np.maximum(add(f), 1)
    some = np.maximum(total - none, 1e-9)
    mean = add(f * k) / total
    elite = np.maximum(add(f * k * k) / np.maximum(add(f * k), 1e-9), 1.0) + 0.1  # mean count seen from an occurrence
    rest = np.maximum(mean * 0.2, 1e-9)
    share = np.clip(some / total * 0.5, 1e-12, 0.5)
    for _ in range(steps):
        z = (np.log(share) - np.log1p(-share) - (elite - rest))[term_] + k * (np.log(elite) - np.log(rest))[term_]
        r = f / (1 + np.exp(-np.clip(z, -700, 700)))
        in_elite = add(r)
        share = np.clip(in_elite / total, 1e-12, 0.5)
        elite = np.maximum(add(r * k) / np.maximum(in_elite, 1e-12), 1e-6)
        rest = np.maximum(add((f - r) * k) / np.maximum(total - in_elite, 1e-12), 1e-9)
        elite = np.maximum(elite, rest * (1 + 1e-9))
    return share, elite, rest


def _counter(vocabulary: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, tfs, held = [], [], [], []
            for i, text, keys in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                own = {k.strip().lower() for k in keys or () if k} - {""}
                counts = Counter(words(text) if vocabulary is None else filter(vocabulary.__contains__, words(text)))
                for t in own:
                    ids.append(i), terms.append(t), tfs.append(counts.pop(t, 0)), held.append(1)
                for t, n in counts.items():
                    ids.append(i), terms.append(t), tfs.append(n), held.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(held, pa.int32())], schema=_ROWS)

    return run


def _fitter(n_records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hist = batch.column("hist")
            offsets = hist.offsets.to_numpy()
            entries = hist.values
            term = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            part = slice(int(offsets[0]), int(offsets[-1]))
            count, freq = (entries.field(c).to_numpy(zero_copy_only=False)[part] for c in ("tf", "n"))
            real = count > 0
            share, elite, rest = fit(term[real], count[real], freq[real], batch.num_rows, n_records)
            yield pa.RecordBatch.from_arrays(
                [batch.column("term"), batch.column("df"), pa.array(np.log(share) - np.log1p(-share)), pa.array(np.log(elite) - np.log(rest)), pa.array(elite - rest)], schema=_MODEL
            )

    return run


def scores(records: DataFrame, most_terms: int = 200_000, most_bytes: int = 8_000_000) -> DataFrame:
    """(id, term, tf, df, score) for each key term of records(id, text, keys array<string>).

    tf: occurrences in the record's text; df: records that hold the term as a key.
    """
    records = spread(records.where("id is not null").select("id", "text", "keys"))
    terms = records.select(F.explode("keys").alias("key")).distinct().select(norm(F.col("key")).alias("term")).where("term is not null and term <> ''").distinct()
    held = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    few = held["n"] <= most_terms and held["bytes"] <= most_bytes
    some = frozenset(r[0] for r in terms.collect()) if few else None
    rows = records.mapInArrow(_counter(some), "id string, term string, tf long, held int")
    if not few:
        rows = rows.join(terms, "term", "left_semi")
    # the same filter on both uses, so that one exchange serves them
    rows = rows.where("term is not null and id is not null").groupBy("id", "term").agg(F.max("tf").alias("tf"), F.max("held").alias("held"))
    n_records = records.select("id").distinct().count()
    hist = rows.groupBy("term", "tf").agg(F.count("*").alias("n"), F.sum("held").alias("h"))
    hist = hist.groupBy("term").agg(F.sum("h").alias("df"), F.collect_list(F.struct("tf", "n")).alias("hist"))
    model = hist.mapInArrow(_fitter(n_records), "term string, df long, log_odds double, log_ratio double, rate_gap double")
    held = rows.where("held = 1").join(F.broadcast(model) if few else model, "term")
    odds = F.col("log_odds") + F.col("tf") * F.col("log_ratio") - F.col("rate_gap")
    score = F.when(F.col("tf") == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds)))))
    return held.select("id", "term", "tf", "df", score.alias("score"))
