"""Language identification by Bayesian fusion of the text, the declared language and the address.

The text's likelihood comes from byte trigrams of each language, against a class ``und`` under which
all trigrams are alike.  A declared language counts by how often documents of each language declare
it.  Hosts have priors: the language counts of their documents, smoothed towards those of the
address suffix, and these towards those of the corpus.  Counts are grouped aggregations over all
documents; only the trigram model is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import row_slices, write_table

UNKNOWN = "und"
#: Labelled documents per language that the trigram model is fitted on (expected number; picked by the hash of their ids).
SAMPLE = 2_000
#: Hash classes of trigrams; what a text's trigrams level off at; pseudo-documents of a smoothed prior.
CLASSES, EVIDENCE, STRENGTH = 1 << 15, 100.0, 20.0
#: Trigrams of a document that is a whole vote in its host's prior.
VOTE = 30
#: Share of a language's trigrams that are as likely as any.
CHANCE = 0.1
#: Prior of ``und``, and the posterior that a language needs.
PRIOR_UNKNOWN, LEAST = 0.01, 0.5
_BLOCK = 1 << 20


#: Bytes as trigrams see them: A-Z in lower case, white space as a space.
_BYTES = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in bytes(range(256)).lower())


def _trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Classes of the trigrams around each letter, of letters and spaces only: digits and signs tell no language."""
    b = np.frombuffer(b" " + text.translate(_BYTES) + b" ", dtype=np.uint8)
    for at in range(0, len(b) - 2, _BLOCK):
        x = b[at : at + _BLOCK + 2]
        letter = (x >= 97) & (x <= 122) | (x >= 128)
        fits = letter | (x == 32)
        x = x.astype(np.uint32)
        mixed = ((x[:-2] * 0x9E5 + x[1:-1]) * 0x3C7 + x[2:]) * np.uint32(0x9E3779B1) >> np.uint32(17)
        yield mixed[fits[:-2] & letter[1:-1] & fits[2:]]


def language_code(declared: Column) -> Column:
    """The first subtag in lower case, null if it has no letters."""
    code = F.regexp_extract(F.lower(declared), "^\\s*([a-z]+)", 1)
    return F.when(code != "", code)


def host_name(address: Column) -> Column:
    """The host of a URL, or the address itself where it isn't one; null is empty."""
    whole = F.lower(F.coalesce(address, F.lit("")))
    return F.when(F.instr(whole, "://") > 0, F.regexp_extract(whole, "://([^/?#]*)", 1)).otherwise(whole)


def address_suffix(host: Column) -> Column:
    """The host's last label, empty where it has but one."""
    return F.regexp_extract(host, "\\.([^.:]+)(:[0-9]*)?$", 1)


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigram classes in each language, as far as they are above those of a class that the language hasn't.

    The entries of class h are ``spot[h]`` to ``spot[h + 1]`` of ``place`` (the language) and
    ``more``; a language takes as many as its sampled documents have classes.
    """

    languages: tuple[str, ...]
    spot: np.ndarray
    place: np.ndarray
    more: np.ndarray

    def score(self, text: bytes) -> tuple[int, np.ndarray]:
        """Trigrams, 0 for a text without letters, and each language's log-likelihood; the last is that of ``und``."""
        n, total = 0, np.zeros(len(self.languages) + 1)
        for h in _trigrams(text):
            n += len(h)
            seen, times = np.unique(h, return_counts=True)
            first, size = self.spot[seen], self.spot[seen + 1] - self.spot[seen]
            at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            total += np.bincount(self.place[at], self.more[at] * np.repeat(times, size), minlength=len(total))
        total[:-1] += n * np.log(CHANCE / CLASSES)
        total[-1] = -n * np.log(CLASSES)
        return n, total


def fit_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    """The trigram model of all languages that are labels, however rare.

    The driver gets the trigram classes that each language's sampled documents have, ``CLASSES`` rows
    per language at most.  Without labelled rows there is only ``und``.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), language_code(F.col(label_col)).alias("label")).where("label is not null and label <> 'und'")
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    spot, place, more = np.zeros(CLASSES + 1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    if languages:
        shares = docs.sparkSession.createDataFrame([(x, i, min(1 << 30, (sample << 30) // sizes[x])) for i, x in enumerate(languages)], "label string, place int, share long")
        picked = labelled.join(F.broadcast(shares), "label").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share")).select("place", "text")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in row_slices(batch, 1):
                    keys = [np.int64(i.as_py()) * CLASSES + h for i, text in zip(*part.columns, strict=True) for h in _trigrams(text.as_py() or b"")]
                    key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((key // CLASSES).astype(np.int32)), pa.array((key % CLASSES).astype(np.int32)), pa.array(n.astype(np.int64))], names=["place", "gram", "n"])

        got = picked.mapInArrow(count, "place int, gram int, n long").groupBy("place", "gram").agg(F.sum("n").alias("n")).toPandas()
        gram, place, n = (got[c].to_numpy().astype(np.int64) for c in ("gram", "place", "n"))
        order = np.lexsort((place, gram))
        gram, place, n = gram[order], place[order], n[order]
        spot = np.searchsorted(gram, np.arange(CLASSES + 1))
        whole = np.maximum(1, np.bincount(place, n, minlength=len(languages)))
        # A share of chance in every language: a new word must not weigh more than many known ones.
        more = np.log1p((1 - CHANCE) * n / whole[place] * (CLASSES / CHANCE))
    return TextModel(languages, spot, place.astype(np.int32), more.astype(np.float32))


def _scored(docs: DataFrame, model: TextModel, columns: list[Column], text_col: str) -> DataFrame:
    """``columns`` (names and types kept) with n and ll."""
    picked = docs.select(*columns, F.col(text_col).cast("binary").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + ", n long, ll array<double>"
    last = len(columns)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # an entry for each class of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.score
        for batch in batches:
            for part in row_slices(batch, last):
                done = [score(t.as_py() or b"") for t in part.column(last)]
                more = [pa.array([n for n, _ in done], pa.int64()), pa.array([x for _, x in done], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *more], names=[*part.schema.names[:last], "n", "ll"])

    return picked.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", address_col: str = "source", model: TextModel | None = None, extra: Column | None = None) -> DataFrame:
    """(id, lang, posterior, text_lang, declared, host, accepted) of every row, and ``extra`` as key.

    ``lang`` is the language of the largest posterior (ties go to the first code); ``und`` where it
    fits no better than chance, or where the text has no letters: null, empty, digits only.
    ``accepted`` is false for these and below a posterior of ``LEAST``; where no row has a label, so that
    there is no model, it is true of every text with letters.  Null declarations and
    addresses are no evidence.  Rows that repeat an id are judged each.
    """
    model = model or fit_text(docs, id_col, text_col, declared_col)
    names, spark = [*model.languages, UNKNOWN], docs.sparkSession
    host = host_name(F.col(address_col))
    columns = [F.col(id_col), language_code(F.col(declared_col)).alias("declared"), host.alias("host"), address_suffix(host).alias("suffix")] + ([] if extra is None else [extra.alias("key")])
    scored = write_table(_scored(docs, model, columns, text_col), "likelihoods")
    code = F.array(*(F.lit(x) for x in names))
    best = lambda xs: F.when(F.col("n") > 0, F.element_at(code, F.array_position(xs, F.array_max(xs)).cast("int"))).otherwise(UNKNOWN)
    scored = scored.withColumn("text_lang", best(F.col("ll")))
    known = scored.where(F.col("text_lang") != UNKNOWN)

    # What each language declares; a row for each pair of languages at most.
    kinds = spark.createDataFrame([(x,) for x in model.languages], "d string")
    told = known.where("declared is not null").groupBy("text_lang", F.col("declared").alias("d")).count()
    said, totals = {}, {}
    for r in told.join(F.broadcast(kinds.withColumn("known", F.lit(True))), "d", "left").groupBy("text_lang", F.when(F.col("known"), F.col("d")).alias("d")).agg(F.sum("count").alias("n")).collect():
        said.setdefault(r.d or "", {})[r.text_lang] = r.n
        totals[r.text_lang] = totals.get(r.text_lang, 0) + r.n
    share = lambda d: [float(np.log((said.get(d, {}).get(x, 0) + 1.0) / (totals.get(x, 0) + len(names)))) for x in model.languages]
    declares = spark.createDataFrame([(d, [*share(d), float(-np.log(len(names)))]) for d in [*model.languages, ""]], "d string, _told array<double>")

    # A text of few trigrams is less than a vote.
    vote = F.least(F.lit(1.0), F.col("n") / F.lit(float(VOTE)))
    votes = known.groupBy("host", "suffix", "text_lang").agg(F.sum(vote).alias("v"))
    # A row per host with the languages it has, in the order of all languages.
    langs = F.map_from_entries(F.collect_list(F.struct("text_lang", "v")))
    dense = lambda xs: F.transform(F.slice(code, 1, len(model.languages)), lambda x: F.coalesce(F.try_element_at(xs, x), F.lit(0.0)))
    hosts = votes.groupBy("host", "suffix").agg(langs.alias("c"), F.sum("v").alias("docs")).withColumn("c", dense(F.col("c")))
    ends = votes.groupBy("suffix", "text_lang").agg(F.sum("v").alias("v"))
    suffixes = ends.groupBy("suffix").agg(langs.alias("cs"), F.sum("v").alias("ds")).withColumn("cs", dense(F.col("cs")))
    sums = {r.text_lang: r.v for r in ends.groupBy("text_lang").agg(F.sum("v").alias("v")).collect()}
    total = [sums.get(x, 0.0) for x in model.languages]
    overall = [(x + 1.0) / (sum(total) + len(total)) for x in total]
    smooth = lambda counts, docs_, prior: F.zip_with(counts, prior, lambda c, p: (c + F.lit(STRENGTH) * p) / (docs_ + F.lit(STRENGTH)))
    flat = F.array(*(F.lit(x) for x in overall)) if overall else F.expr("cast(array() as array<double>)")
    priors = hosts.join(suffixes, "suffix").select("host", smooth(F.col("c"), F.col("docs"), smooth(F.col("cs"), F.col("ds"), flat)).alias("prior"))

    fused = scored.join(priors, "host", "left")
    # A declared language that is no label has the row of the empty name.
    fused = fused.join(F.broadcast(kinds.withColumn("_label", F.col("d"))), F.col("declared") == F.col("d"), "left").drop("d")
    fused = fused.join(F.broadcast(declares), F.coalesce("_label", F.lit("")) == F.col("d"), "left").drop("d")
    nothing = F.array(*(F.lit(0.0) for _ in names))
    declared = F.when(F.col("declared").isNull(), nothing).otherwise(F.coalesce("_told", nothing))
    # Trigrams of one text depend on one another: n of them are the evidence of n * EVIDENCE / (n + EVIDENCE).
    weight = F.lit(EVIDENCE) / (F.col("n") + F.lit(EVIDENCE))
    prior = F.concat(F.transform(F.coalesce("prior", flat), lambda p: F.log(p * (1 - PRIOR_UNKNOWN))), F.array(F.lit(float(np.log(PRIOR_UNKNOWN)))))
    fused = fused.withColumn("_logs", F.zip_with(F.zip_with("ll", prior, lambda a, b: a * weight + b), declared, lambda a, b: a + b))
    fused = fused.withColumn("lang", best(F.col("_logs")))
    mass = F.aggregate(F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs"))), F.lit(0.0), lambda a, x: a + x)
    fused = fused.withColumn("posterior", F.when(F.col("n") > 0, F.round(1 / mass, 6)).otherwise(F.lit(0.0)))
    # Without a model no text fits better than chance: letters are all there is to judge by.
    accepted = (F.col("lang") != UNKNOWN) & (F.col("posterior") >= LEAST) if model.languages else F.col("n") > 0
    return fused.select(id_col, "lang", "posterior", "text_lang", "declared", "host", accepted.alias("accepted"), *([] if extra is None else ["key"]))


def evidence_key(text_col: str = "text", declared_col: str = "lang", address_col: str = "source") -> Column:
    """A hash of all that a row is judged by: rows of one id and key are judged alike."""
    return F.xxhash64(*(x for c in (text_col, declared_col, address_col) for x in (F.isnull(c), F.col(c))))


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, lang, source) of web pages: the text outside tags, the lang attribute of the html tag, the URL."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#a-z0-9]+;", " ")
    lang = F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-z-]+)""", 1)
    return pages.select(F.col(id_col), bare.alias("text"), F.when(lang != "", lang).alias("lang"), F.col(url_col).alias("source"))
