"""Language of a text, from all the evidence there is.

For each language the log posterior is the sum of
  the text: naive Bayes over byte trigrams of the whole text (letters in lower case, all else a space). Trigrams are
    not independent, so a text counts like at most ``EVIDENCE`` of them: the mean log likelihood times
    EVIDENCE (1 - exp(-n / EVIDENCE));
  the markup: how often pages in that language declare what this page declares;
  the address: the prior of its host, smoothed by the prior of its suffix, that by the share in the whole corpus
    (Dirichlet, ``PSEUDO`` each), a suffix of a country leaning to that country's language. The priors come from
    grouped counts of what the texts alone say; a row's own vote is taken out of its host's and suffix's counts.
One more class, ``und``, holds texts that no language explains: each trigram equally likely.

The trigram model is fitted on at most ``SAMPLE`` labelled rows of each language (the smallest hashes), so a rare
language is learnt in a corpus of any size; everything else covers all rows. Tables: one row of trigram weights per language, one row of counts per host; nothing else gathers.

A row is accepted if the best class is a language and its posterior is ``ENOUGH``. Defined cases: a text without
letters, empty or null has language und and is not accepted; null hosts, suffixes and declarations are no evidence;
a null label is not trained on; ties go to the first language in order; repeated rows are judged alike up to their
own vote. Without labelled rows every text is und.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import stage, with_row_id

SAMPLE, BUCKETS, ROWS_AT_A_TIME = 5_000, 1 << 16, 256
EVIDENCE, PSEUDO, ENOUGH = 60.0, 10.0, 0.5
UNKNOWN = "und"
#: The language most pages of a country's suffix are in, where that is one of many.
SUFFIX_LANGUAGE = {
    "at": "de", "ar": "es", "br": "pt", "ch": "de", "cl": "es", "cn": "zh", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en",
    "it": "it", "jp": "ja", "mx": "es", "nl": "nl", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "ru": "ru", "uk": "en", "us": "en",
}
_SPACES = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each trigram of the letters of a text."""
    kept = b" ".join((text or "").lower().encode().translate(_SPACES).split())
    if not kept:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + kept + b" ", np.uint8).astype(np.uint32)
    return (((b[:-2] * np.uint32(961) + b[1:-1]) * np.uint32(1009) + b[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def visible(html: str | None) -> str:
    """What a page shows, in one pass: no scripts, styles, comments or tags."""
    parts, until = (html or "").split("<"), None
    out = [parts[0]]
    for part in parts[1:]:
        if until == "-->":
            at = part.find("-->")
            if at >= 0:
                until = None
                out.append(part[at + 3 :])
            continue
        name = part[:9].lower()
        if until is not None:
            if not name.startswith(until):
                continue
            until = None
        elif part.startswith("!--"):
            at = part.find("-->", 3)
            until = None if at >= 0 else "-->"
            out.append(part[at + 3 :] if at >= 0 else "")
            continue
        elif name.startswith(("script", "style")):
            until = "/script" if name.startswith("script") else "/style"
            continue
        out.append(part.partition(">")[2])
    return " ".join(out)


def _bounded_sample(labelled: DataFrame, sample: int) -> DataFrame:
    """text and label of at most ``sample`` rows of each label: those with the smallest hashes of id and text.

    Only hashes are numbered, and of those only a share that by the label's count holds a few more than that; texts
    are read where they are and compared with their label's last hash.
    """
    mixed = labelled.where(F.col("label").isNotNull()).withColumn("mixed", F.xxhash64(F.lit(3), F.col("id"), F.col("text")))
    counts = stage(mixed.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels")
    share = F.least(F.lit(1.0), F.lit(1.25 * sample + 200) / F.col("n"))
    cut = mixed.select("label", "mixed").join(counts, "label").where((F.col("mixed") / F.lit(2.0**64) + 0.5) <= share)
    first = Window.partitionBy("label").orderBy("mixed")
    last = cut.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample).groupBy("label").agg(F.max("mixed").alias("last"))
    return mixed.join(stage(last, "last-hashes"), "label").where(F.col("mixed") <= F.col("last")).select("text", "label")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and log weights (bucket, language) from rows with id, text and label."""
    chosen = _bounded_sample(labelled, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in _parts(batches):
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                totals.setdefault(label, np.zeros(BUCKETS, np.int64))
                totals[label] += np.bincount(trigrams(text), minlength=BUCKETS)
        for label, n in totals.items():
            real = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(real), pa.string()), pa.array(real, pa.int32()), pa.array(n[real], pa.int64())], names=["label", "bucket", "n"]
            )

    sums = chosen.mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(sums.column("label").to_pylist()))
    n = np.zeros((BUCKETS, len(languages)))
    n[sums.column("bucket").to_numpy(), np.array([languages.index(x) for x in sums.column("label").to_pylist()], np.int64)] = sums.column("n").to_numpy()
    return languages, np.log((n + 0.05) / (n.sum(axis=0) + 0.05 * BUCKETS)).astype(np.float32)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of ``ROWS_AT_A_TIME``: what a task holds as Python texts does not grow with a batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
            yield batch.slice(start, ROWS_AT_A_TIME)


def text_evidence(rows: DataFrame, languages: list[str], weights: np.ndarray, html: bool = False) -> DataFrame:
    """Adds said (log likelihood per class, the last is und, tempered) and vote (the best class, null without letters);
    the text goes no further."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # one row per trigram bucket
    carried = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in _parts(batches):
            said, votes = [], []
            for text in part.column("text"):
                text = text.as_py()
                grams = trigrams(visible(text) if html else text)
                n = len(grams)
                means = np.full(w.shape[1] + 1, -np.log(BUCKETS))
                if n:
                    # In pieces, so that a long text does not need its size in weights.
                    means[:-1] = sum(w[grams[k : k + 100_000]].sum(axis=0, dtype=np.float64) for k in range(0, n, 100_000)) / n
                total = means * EVIDENCE * (1 - np.exp(-n / EVIDENCE))
                said.append((total - total.max()).tolist())
                votes.append(int(total.argmax()) if n else None)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in carried], pa.array(said, pa.list_(pa.float64())), pa.array(votes, pa.int32())],
                names=[*carried, "__said", "__vote"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in carried]
    return rows.mapInArrow(run, ", ".join([*fields, "__said array<double>", "__vote int"]))


def _counts(rows: DataFrame, by: str, k: int) -> DataFrame:
    """One row per value: how many rows of it vote for each class."""
    votes = [F.count(F.when(F.col("__vote") == i, 1)) for i in range(k)]
    return rows.where(F.col(by).isNotNull() & F.col("__vote").isNotNull()).groupBy(by).agg(F.array(*votes).alias(f"{by}_n"))


def _smoothed(counts: Column, prior: Column, own: Column, pseudo: float) -> Column:
    """(n - own vote + pseudo * prior) / (sum + pseudo), without the row's own vote."""
    less = F.transform(counts, lambda n, i: n - F.when(i == own, 1).otherwise(0))
    total = F.aggregate(less, F.lit(0).cast("bigint"), lambda a, n: a + n)
    return F.zip_with(less, prior, lambda n, p: (n + pseudo * p) / (total + pseudo))


def fuse(rows: DataFrame, languages: list[str], pseudo: float = PSEUDO) -> DataFrame:
    """Adds __lang and __posterior to rows with __said, __vote, __host, __suffix and __declared."""
    classes = [*languages, UNKNOWN]
    k = len(classes)
    share = rows.where("__vote is not null").agg(*[F.count(F.when(F.col("__vote") == i, 1)).alias(f"n{i}") for i in range(k)]).first()
    whole = sum(share) + k
    corpus = F.array(*[F.lit((n + 1) / whole) for n in share])
    hosts, suffixes = (stage(_counts(rows, c, k), c.strip("_")) for c in ("__host", "__suffix"))
    # What pages declare, by the language their text is in: one row per declared value.
    declared = stage(_counts(rows, "__declared", k), "declared")
    spoken = declared.agg(*[F.coalesce(F.sum(F.get("__declared_n", F.lit(i))), F.lit(0)).alias(f"n{i}") for i in range(k)]).first()
    rows = rows.join(hosts, "__host", "left").join(suffixes, "__suffix", "left").join(declared, "__declared", "left")
    none = F.array(*[F.lit(0).cast("bigint")] * k)
    own = F.coalesce("__vote", F.lit(-1))
    leaning = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    country = F.array_position(F.array(*[F.lit(c) for c in classes]), F.coalesce(leaning[F.col("__suffix")], F.lit(""))) - 1
    base = F.transform(corpus, lambda p, i: F.when(country < 0, p).otherwise(0.5 * p + F.when(i == country, 0.5).otherwise(0.0)))
    rows = rows.withColumn("__base", base)
    rows = rows.withColumn("__base", _smoothed(F.coalesce("__suffix_n", none), F.col("__base"), F.when(F.col("__suffix").isNull(), -1).otherwise(own), pseudo))
    rows = rows.withColumn("__prior", _smoothed(F.coalesce("__host_n", none), F.col("__base"), F.when(F.col("__host").isNull(), -1).otherwise(own), pseudo))
    matches = F.array(*[F.lit(c) for c in classes])
    in_class = F.array(*[F.lit(float(n)) for n in spoken])
    # P(declared | language): seen counts, with a weight of ``pseudo`` on declaring the language one is in.
    markup = F.when(F.col("__declared").isNull(), F.array(*[F.lit(0.0)] * k)).otherwise(F.transform(
        F.coalesce("__declared_n", none),
        lambda n, i: F.log(
            (n - F.when(i == own, 1).otherwise(0) + pseudo * F.when(F.get(matches, i) == F.col("__declared"), 0.8).otherwise(0.2 / k))
            / (F.get(in_class, i) - F.when(i == own, 1).otherwise(0) + pseudo)
        ),
    ))
    rows = rows.withColumn("__sum", F.zip_with(F.zip_with("__said", markup, lambda a, b: a + b), "__prior", lambda a, p: a + F.log(p)))
    top = F.array_max("__sum")
    best = F.array_position("__sum", top).cast("int") - 1
    mass = F.aggregate(F.transform("__sum", lambda x: F.exp(x - F.array_max(F.col("__sum")))), F.lit(0.0), lambda a, x: a + x)
    silent = F.col("__vote").isNull()
    return rows.withColumn("__lang", F.when(silent, UNKNOWN).otherwise(F.get(matches, best))).withColumn(
        "__posterior", F.when(silent, F.lit(0.0)).otherwise(1.0 / mass)
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """url and html as __host, __suffix, __declared and text (the html itself)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    host = F.regexp_replace(host, r"^(?:www\.)", "")
    suffix = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html(?=\s)[^<>]*?\slang\s*+=\s*+[\"']?([A-Za-z]{2,3})", 1))
    some = lambda c: F.when(c != "", c)
    return pages.select("page_id", some(host).alias("__host"), some(suffix).alias("__suffix"), some(declared).alias("__declared"), F.col("html").alias("text"))


def identify(documents: DataFrame, pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document and page: doc_id, page_id, lang, posterior, accepted.

    Documents are trained on; they come with a source, which stands for the host, and no address or markup.
    """
    languages, weights = fit(documents.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")), sample)
    no = F.lit(None).cast("string")
    texts = documents.select("doc_id", F.concat(F.lit("source:"), F.col("source")).alias("__host"), no.alias("__suffix"), no.alias("__declared"), "text")
    from_texts = text_evidence(texts, languages, weights).withColumn("page_id", F.lit(None).cast("bigint"))
    from_pages = text_evidence(page_evidence(pages), languages, weights, html=True).withColumn("doc_id", F.lit(None).cast("bigint"))
    rows = stage(from_texts.unionByName(from_pages), "evidence")
    return fuse(rows, languages).select(
        "doc_id", "page_id", F.col("__lang").alias("lang"), F.col("__posterior").alias("posterior"),
        ((F.col("__lang") != UNKNOWN) & (F.col("__posterior") >= ENOUGH)).alias("accepted"),
    )


def in_a_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows that are accepted, with the columns of ``docs``."""
    languages, weights = fit(docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")), sample)
    no = F.lit(None).cast("string")
    rows = with_row_id(docs)
    evidence = text_evidence(rows.select("__row", F.concat(F.lit("source:"), F.col("source")).alias("__host"), "text"), languages, weights)
    judged = fuse(stage(evidence.select("__row", "__host", no.alias("__suffix"), no.alias("__declared"), "__said", "__vote"), "evidence"), languages)
    refused = judged.where((F.col("__lang") == UNKNOWN) | (F.col("__posterior") < ENOUGH)).select("__row")
    return rows.join(stage(refused, "refused"), "__row", "left_anti").select(*docs.columns)
