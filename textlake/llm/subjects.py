"""Problem 2: the subjects of each document, by latent Dirichlet topics.

Terms are Han 2- to 4-grams, words and word pairs of middling frequency; no label has a part in their choice. Topics are fitted by variational EM in
two steps. On a bounded sample of labelled rows a document may use only the topics of its labels and some common ones, and EM finds out which of its
words belong to which (so the topics begin with a meaning). Then one pass over the whole corpus, in which every document is free to use every topic,
adds what unlabelled text says. Executors infer the topics of their documents and send sums of topics by terms. Each topic is mapped to a subject by
its top terms, through the labels of the rows they stand in, or to none where these are mixed.
For every document of the corpus the proportions of the topics are inferred; its words pass the proportions on to its sentences, and a document has
the subjects to whose topics a large enough share of its sentences belongs.
(Topics without the labelled beginning split and merged subjects: of 40 topics over sentences none could be mapped, 30 to 48 topics over documents
reached a recall of 0.7 on the labels.)
The labelled sample is the only bounded part: at most SAMPLE_ROWS rows, and at most MAX_TERMS terms of them, the rarest left out where they are more.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.forms import former, skeleton
from textlake.runtime import materialize, table

#: Labelled rows the topics begin with at most; the bound of the vocabulary.
SAMPLE_ROWS = 4000
MAX_TERMS = 200_000
#: A term stands in so large a part of the sample's rows at least, and in two of them, and in so large a part at most; a part of a longer term that
#: stands in this share of its rows goes.
LEAST_SHARE, MAX_SHARE, WITHIN = 0.0015, 0.03, 0.8
#: Topics beside one for each subject; passes over the sample; steps in each document of the sample and of the corpus; priors of a document's topics
#: and of a topic's terms.
COMMON_TOPICS = 6
ITERATIONS = 8
STEPS, CORPUS_STEPS = 4, 6
ALPHA, ETA = 0.1, 0.01
#: Tasks of an EM round over the sample; each sends one block of topics by terms to the driver.
SAMPLE_TASKS = 8
#: Top terms by which a topic is named, and the part of their weight that one subject needs.
TOP_TERMS = 20
TOPIC_PURITY = 0.5
#: A sentence belongs to a subject if its words give so much of themselves to the subject's topics, and to no other more.
SENTENCE_MASS = 0.6
#: A document has a subject from this share of its sentences on; one sentence alone is a share only in texts of up to SHORT sentences.
MIN_SHARE = 0.18
SHORT = 5

HAN_RUN = re.compile("[㐀-鿿]+")
LATIN_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
SENTENCE_END = re.compile(r"[。!?！？;；\n]+|[.](?=\s|$|[\"”])")
LETTERS = re.compile(r"[^\W\d_]")


def candidate_terms(form: str) -> set[str]:
    out: set[str] = set()
    for run in HAN_RUN.findall(form):
        for n in (2, 3, 4):
            out.update(run[i : i + n] for i in range(len(run) - n + 1))
    words = LATIN_WORD.findall(form)
    out.update(words)
    out.update(map(" ".join, zip(words, words[1:])))
    return out


class Matcher:
    """Longest non-overlapping matches of the vocabulary, sentence by sentence."""

    def __init__(self, values: dict[str, object]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, v in values.items():
            self.automaton.add_word(term, (len(term), v))
        if values:
            self.automaton.make_automaton()
        self.empty = not values

    def __call__(self, form: str) -> list[list[object]]:
        """For each sentence of at least four letters the values of its matches."""
        cuts = [m.end() for m in SENTENCE_END.finditer(form)]
        cuts.append(len(form))
        hits = [] if self.empty else self.automaton.iter_long(form)
        out: list[list[object]] = []
        hit = next(iter_ := iter(hits), None)
        a = 0
        for b in cuts:
            found = []
            while hit is not None and hit[0] < b:
                end, (n, v) = hit
                c = form[end]
                # Latin terms count at word borders only.
                if not c.isascii() or not ((end + 1 < len(form) and form[end + 1].isalpha() and form[end + 1].isascii()) or (end - n >= 0 and form[end - n].isalpha() and form[end - n].isascii())):
                    found.append(v)
                hit = next(iter_, None)
            if found or b - a >= 4 and len(LETTERS.findall(form, a, b)) >= 4:
                out.append(found)
            a = b
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, subjects) of at most rows labelled documents, those of the smallest hashes; subjects without 'none'."""
    by_row = labels.where("row_id is not null and subject is not null").groupBy("row_id").agg(F.collect_set("subject").alias("subjects"))
    chosen = by_row.orderBy(F.xxhash64("row_id")).limit(rows)
    return docs.select("row_id", "text").where("text is not null").join(F.broadcast(chosen), "row_id").select("text", F.array_remove("subjects", "none").alias("subjects"))


def vocabulary(sample: DataFrame, least_share: float = LEAST_SHARE, max_share: float = MAX_SHARE) -> list[str]:
    """The terms, sorted. Rows are counted per batch before the shuffle; where more than MAX_TERMS terms remain, the rarest go until they fit."""
    make = former(sample.sparkSession, skeleton)

    def run(batches):
        forms = make()
        for b in batches:
            counts: Counter = Counter()
            for form in forms(b.column(0).to_pylist()):
                counts.update(candidate_terms(form.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    size = sample.count()
    min_rows, top = max(2, round(least_share * size)), max_share * size
    n = materialize(sample.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).where((F.col("n") >= min_rows) & (F.col("n") <= top)))
    total, least = 0, min_rows
    for r in n.groupBy("n").count().orderBy(F.desc("n")).collect():
        total += r["count"]
        if total > MAX_TERMS:
            least = r["n"] + 1
            break
    rows = {r.term: r.n for r in n.where(F.col("n") >= least).collect()}
    parts = {u for t, k in rows.items() if len(t) > 2 and HAN_RUN.fullmatch(t) for u in (t[1:], t[:-1]) if k >= WITHIN * rows.get(u, k / WITHIN + 1)}
    return sorted(rows.keys() - parts)


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive numbers, to about 1e-8: the recurrence six times, then the asymptotic series."""
    x = np.asarray(x, np.float64)
    y = x + 6
    z = 1 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - (1 / (x[..., None] + np.arange(6))).sum(-1)


_X = np.concatenate([np.linspace(1e-3, 2, 4000), np.geomspace(2.001, 1e7, 4000)])
_Y = np.exp(digamma(_X))


def weights(gamma: np.ndarray) -> np.ndarray:
    """exp(digamma(gamma)) by interpolation, to about 1e-4 of the value."""
    return np.interp(gamma.ravel(), _X, _Y).reshape(gamma.shape).astype(np.float32)


def word_weights(topics: np.ndarray) -> np.ndarray:
    """Terms by topics: exp of the expected log probability of a term in a topic."""
    return np.exp(digamma(topics) - digamma(topics.sum(axis=1, keepdims=True))).T.astype(np.float32)


class Bags:
    """Some documents as flat arrays: doc and term of each different term of a document, how often it stands there, and where each token is."""

    def __init__(self, documents: list[list[int]]):
        self.n = len(documents)
        sizes = np.fromiter(map(len, documents), np.int64, self.n)
        token = np.fromiter((t for d in documents for t in d), np.int64, int(sizes.sum()))
        key = (np.repeat(np.arange(self.n), sizes) << 32) + token
        unique, self.of_token, count = np.unique(key, return_inverse=True, return_counts=True)
        self.doc, self.term, self.count = unique >> 32, unique & 0xFFFFFFFF, count.astype(np.float32)

    def infer(self, beta: np.ndarray, steps: int, allowed: np.ndarray | None = None) -> np.ndarray:
        """Expected topics of each (doc, term), its count dealt out: the variational parameters after so many steps. allowed: documents by topics."""
        k = beta.shape[1]
        if not len(self.doc):
            return np.zeros((0, k), np.float32)
        b = beta[self.term]
        if allowed is not None:
            b = b * allowed[self.doc]
        starts = np.flatnonzero(np.append(True, self.doc[1:] != self.doc[:-1]))
        row = np.cumsum(np.append(False, self.doc[1:] != self.doc[:-1]))
        gamma = ALPHA + np.repeat(np.add.reduceat(self.count, starts)[:, None] / k, k, axis=1)
        q = b
        for _ in range(steps):
            q = weights(gamma)[row] * b
            q *= (self.count / (q.sum(axis=1) + 1e-30))[:, None]
            gamma = ALPHA + np.add.reduceat(q, starts, axis=0)
        return q

    def sums(self, q: np.ndarray, terms: int) -> np.ndarray:
        """Topics by terms."""
        return np.stack([np.bincount(self.term, q[:, k], terms) for k in range(q.shape[1])]) if len(q) else np.zeros((q.shape[1], terms))


class Model:
    """Terms, topics by terms, and the subject of each topic (None where it has none)."""

    def __init__(self, terms: list[str], topics: np.ndarray, subjects: list[str | None]):
        self.terms, self.topics, self.subjects = terms, topics, subjects


def term_bags(df: DataFrame, terms: list[str], keep: list[str], text: str = "text") -> DataFrame:
    """(keep, ids, sizes): the terms of each text by their numbers, one sentence after another, and how many each sentence has. Null and empty texts
    give no row."""
    make = former(df.sparkSession, skeleton)
    src = df.select(*keep, F.col(text).cast("string").alias("_t")).where("_t <> ''")
    at = {w: i for i, w in enumerate(terms)}

    def run(batches):
        forms, matcher = make(), Matcher(at)
        for b in batches:
            found = [matcher(form.lower()) for form in forms(b.column(len(keep)).to_pylist())]
            ids = [[i for s in x for i in s] for x in found]
            sizes = [list(map(len, x)) for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], [*keep, "ids", "sizes"])

    return src.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)]) + f"{', ' * bool(keep)}ids array<int>, sizes array<int>")


def fit_topics(sample: DataFrame, terms: list[str], subjects: list[str], common: int = COMMON_TOPICS, iterations: int = ITERATIONS) -> tuple[np.ndarray, DataFrame]:
    """(topics by terms, bags of the sample). A document of the sample uses the topics of its subjects and the common ones; one without a subject only
    the common ones."""
    bags = materialize(term_bags(sample, terms, ["subjects"]).repartition(SAMPLE_TASKS))
    k, n = len(subjects) + common, len(terms)
    number = {s: i for i, s in enumerate(subjects)}
    some = np.random.default_rng(7).gamma(5.0, 0.2, (common, n)).astype(np.float32)

    def round_(now: np.ndarray | None):
        def e_step(batches):
            documents, allowed = [], []
            for b in batches:
                for names, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    documents.append(ids)
                    allowed.append([float(j >= len(subjects)) for j in range(k)])
                    for s in names:
                        allowed[-1][number[s]] = 1.0
            if not documents:
                return
            bag, may = Bags(documents), np.array(allowed, np.float32)
            if now is None:
                q = may[bag.doc]
                q = q / q.sum(axis=1, keepdims=True) * bag.count[:, None]
            else:
                q = bag.infer(word_weights(now), STEPS, may)
            yield pa.RecordBatch.from_arrays([pa.array([bag.sums(q, n).astype(np.float32).tobytes()])], ["sums"])

        sums = bags.select("subjects", "ids").coalesce(SAMPLE_TASKS).mapInArrow(e_step, "sums binary").collect()
        return ETA + sum((np.frombuffer(r.sums, np.float32).reshape(k, n).astype(np.float64) for r in sums), np.zeros((k, n)))

    topics = round_(None)
    topics[len(subjects) :] *= some
    for _ in range(iterations):
        topics = round_(topics)
    return topics, bags


def corpus_sums(bags: DataFrame, topics: np.ndarray) -> np.ndarray:
    """Topics by terms of all documents, each free to use every topic. Tasks send one row per term, which are summed before they reach the driver: as
    many rows as there are terms."""
    k, n = topics.shape
    cols = [f"t{i}" for i in range(k)]

    def e_step(batches):
        beta, total = word_weights(topics), np.zeros((k, n))
        for b in batches:
            bag = Bags(b.column(0).to_pylist())
            total += bag.sums(bag.infer(beta, CORPUS_STEPS), n)
        some = np.flatnonzero(total.any(axis=0))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(total[i, some].astype(np.float32)) for i in range(k))], ["term", *cols])

    rows = bags.select("ids").mapInArrow(e_step, "term bigint, " + ", ".join(f"{c} float" for c in cols)).groupBy("term").agg(*(F.sum(c).alias(c) for c in cols)).toPandas()
    out = np.zeros((k, n))
    out[:, rows["term"].to_numpy(np.int64)] = rows[cols].to_numpy(np.float64).T
    return out


def name_topics(topics: np.ndarray, terms: list[str], bags: DataFrame, subjects: list[str]) -> list[str | None]:
    """The subject of each topic: that of the rows in which its top terms stand, each subject's rows weighing the same; None where none has TOPIC_PURITY."""
    share = topics / topics.sum(axis=1, keepdims=True)
    tops = [row.argsort()[::-1][:TOP_TERMS].tolist() for row in share]
    wanted = sorted({i for t in tops for i in t})
    rows = bags.select(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit("none"))).alias("s"), F.array_distinct("ids").alias("ids"))
    sizes = {r.s: r["count"] for r in rows.select(F.explode("s").alias("s")).groupBy("s").count().collect()}
    # A term counts in the top terms of at most all topics: a few hundred rows come back.
    pairs = rows.select("s", F.explode(F.array_intersect("ids", F.array(*map(F.lit, wanted)))).alias("i"))
    few = pairs.select(F.explode("s").alias("s"), "i").groupBy("s", "i").count().collect()
    rate: dict[int, Counter] = {}
    for r in few:
        rate.setdefault(r.i, Counter())[r.s] += r["count"] / sizes[r.s]
    out: list[str | None] = []
    for k, top in enumerate(tops):
        votes: Counter = Counter()
        for i in top:
            total = sum(rate.get(i, {}).values())
            for s, v in rate.get(i, {}).items():
                votes[s] += share[k, i] * v / total
        s, w = max(votes.items(), key=lambda x: (x[1], x[0]), default=("none", 0.0))
        out.append(s if s in subjects and w >= TOPIC_PURITY * sum(votes.values()) else None)
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "row_id", max_share: float = MAX_SHARE) -> tuple[Model, DataFrame] | None:
    """(model, term bags of docs); None where there are no labelled terms to begin with."""
    sample = materialize(labelled_sample(docs, labels))
    subjects = sorted(r.s for r in sample.select(F.explode("subjects").alias("s")).distinct().collect())
    terms = vocabulary(sample, max_share=max_share) if subjects else []
    if not terms:
        return None
    topics, labelled = fit_topics(sample, terms, subjects)
    bags = materialize(term_bags(docs.where(F.col(key).isNotNull()), terms, [key]))
    topics = topics + corpus_sums(bags, topics)
    return Model(terms, topics, name_topics(topics, terms, labelled, subjects)), bags


def subject_shares(bags: DataFrame, model: Model, key: str = "row_id") -> DataFrame:
    """(key, subject, n, sentences): by the inferred topics of each document, sentences of each subject and in all. Documents without a subject's
    sentence give no row."""
    names = sorted({s for s in model.subjects if s})
    of = np.zeros((len(model.subjects), len(names)), np.float32)
    for k, s in enumerate(model.subjects):
        if s:
            of[k, names.index(s)] = 1
    topics = model.topics

    def run(batches):
        beta = word_weights(topics)
        for b in batches:
            bag = Bags(b.column(1).to_pylist())
            q = bag.infer(beta, CORPUS_STEPS)
            per_token = ((q / bag.count[:, None]) @ of)[bag.of_token]
            sizes = b.column(2)
            in_doc = np.diff(sizes.offsets.to_numpy())
            size = sizes.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), in_doc)
            full = np.flatnonzero(size)
            mass = np.add.reduceat(per_token, (np.cumsum(size) - size)[full], axis=0) if len(full) else np.zeros((0, len(names)), np.float32)
            best = mass.argmax(axis=1) if len(names) else np.zeros(0, np.int64)
            clear = mass[np.arange(len(mass)), best] >= SENTENCE_MASS if len(names) else np.zeros(0, bool)
            pair, n = np.unique(owner[full][clear] * len(names) + best[clear], return_counts=True)
            doc = pair // max(len(names), 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array([names[i] for i in pair % max(len(names), 1)], pa.string()), pa.array(n, pa.int32()), pa.array(in_doc[doc], pa.int32())], ["k", "subject", "n", "sentences"])

    src = bags.select(F.col(key).alias("k"), "ids", "sizes")
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, subject string, n int, sentences int").withColumnRenamed("k", key)


def assign(shares: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    return shares.where((F.col("n") >= min_share * F.col("sentences")) & ((F.col("n") > 1) | (F.col("sentences") <= SHORT)))


def document_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "adapted_document"), table(spark, sf_dir, "subject_label")
    if (fitted := train(docs.select("row_id", "text"), labels)) is None:
        return spark.createDataFrame([], "row_id bigint, subject string, n int, sentences int")
    model, bags = fitted
    return assign(subject_shares(bags, model))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(spark, sf_dir).select("row_id", "subject").distinct()


def p2_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents that have it and its sentences in them."""
    return document_subjects(spark, sf_dir).groupBy("subject").agg(F.countDistinct("row_id").alias("documents"), F.sum("n").alias("sentences"))


QUERIES = {"p2_found": p2_found, "p2_composition": p2_composition}
