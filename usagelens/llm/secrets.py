"""Secret scans: a random forest over candidate strings, trained from labelled findings."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.operators.windows import number_in_order
from usagelens.sources.workspace import cut_lineage

#: A candidate: what is assigned to a credential's name, of any length and characters; the password of a URL; the body
#: of a private key; or 16 or more characters of keys and codes, not inside a word.
CANDIDATE = re.compile(
    r"(?<![A-Za-z])(?:(?i:password|passwd|pwd|token|secret|key|auth|credential)[\"']?\s*[=:]\s*[\"']?)(?P<assigned>[^\s\"',;]*[^\s\"',;.:=])"
    r"|://[^\s:/@\"']{1,64}:(?P<url>[^\s/@\"']{1,256})@"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----\s*(?P<pem>[A-Za-z0-9+/=]+(?:\s+[A-Za-z0-9+/=]+)*)"
    r"|(?<!\w)[A-Za-z0-9+/_\-]{16,}={0,2}(?!\w)"
)
#: What directly precedes a candidate, by which labels are given, and which therefore is no feature.
LEAD = re.compile(r"(?:[\w-]+[\"']?\s*[=:]\s*[\"']?|[\w-]+\s+|://\S*:|-----[A-Z ]+-----\s*)$")
#: Words of the dictionary in all.
MAX_WORDS = 200_000
#: Characters before and after a candidate that are looked at.
CONTEXT = 60
# Words whose neighbourhood speaks for or against a secret.
HINTS = ("password", "passwd", "pwd", "token", "secret", "key", "auth", "bearer", "credential")
DOUBTS = ("example", "sample", "test", "dummy", "placeholder", "sha", "md5", "checksum", "commit", "uuid", "phone", "card")
FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "marks", "hexadecimal", "transitions", "letter_transitions", "longest_run",
    "dictionary", "hint_before", "hint_after", "doubt_before", "doubt_after", "quoted", "neighbour_words", "path_doubt", "path_bucket",
)


def dictionary(docs: DataFrame, words: int = 5_000, text_col: str = "text", lang_col: str = "lang") -> frozenset[str]:
    """The commonest words of 3 to 12 letters, of any script, of each language, by the number of documents, over all documents.

    Words are ranked by ranges, so a language may be large; at most ``MAX_WORDS``, the commonest
    ones, come to the driver.
    """
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(\p{L}+)"), 1))
    counted = docs.select(lang.alias("of"), F.explode(found).alias("w")).where(F.length("w").between(3, 12)).groupBy("of", "w").agg(F.count(F.lit(1)).alias("n"))
    ranked = number_in_order(counted, ["of"], [F.col("n").desc(), "w"], name="place", unique_order=True).where(F.col("place") <= words)
    best = ranked.groupBy("w").agg(F.max("n").alias("n")).orderBy(F.col("n").desc(), "w").limit(MAX_WORDS)
    return frozenset(best.toArrow().column("w").to_pylist())


def describe(value: str, before: str, after: str, path: str, known: frozenset[str]) -> list[float]:
    """The ``FEATURES`` of a candidate from its characters, its transitions, neighbours and path.

    The name that it is assigned to, or other word directly before it, is not among them, as
    labels come from there: the forest is to judge by the value and what else stands around it.
    """
    n = len(value)
    quoted = float(before[-1:] in "\"'" and before != "" and after[:1] == before[-1:])
    before = LEAD.sub("", before)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    letters = [c for c in value.lower() if c.isalpha()]
    vowel = sum((a in "aeiou") != (b in "aeiou") for a, b in zip(letters, letters[1:]))
    run = longest = 1
    for a, b in zip(kinds, kinds[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    low, covered, at = value.lower(), 0, 0
    while at < n:
        size = next((k for k in range(min(12, n - at), 2, -1) if low[at: at + k] in known), 0)
        covered, at = covered + size, at + max(1, size)
    earlier, later = before.lower(), after.lower()
    share = lambda kind: kinds.count(kind) / n
    near = lambda text, words: float(any(w in text for w in words))
    return [
        float(n), entropy, share("d"), share("u"), share("l"), share("m"),
        float(all(c in "0123456789abcdefABCDEF" for c in value)), changes / n, vowel / max(1, len(letters)), longest / n,
        covered / n, near(earlier[-24:], HINTS), near(later[:24], HINTS), near(earlier, DOUBTS), near(later, DOUBTS),
        quoted, float(len(earlier.split()) + len(later.split())), near(path.lower(), DOUBTS), float(zlib.crc32(path.encode()) % 16),
    ]


def candidates(docs: DataFrame, known: frozenset[str], id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Every candidate of every whole text: ``doc_id, start, length, value, before, after`` and its ``FEATURES``.

    ``start`` counts characters from 0. Null and empty texts have none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, text_parts, table = [], [], [], []
            for k, (text, path) in enumerate(zip(batch.column("text"), batch.column("path"))):
                whole = text.as_py() or ""
                for m in CANDIDATE.finditer(whole):
                    begin, end = m.span(next((g for g in ("assigned", "url", "pem") if m[g]), 0))
                    parts = (whole[begin:end], whole[max(0, begin - CONTEXT): begin], whole[end: end + CONTEXT])
                    at.append(k)
                    start.append(begin)
                    text_parts.append(parts)
                    table.append(describe(*parts, path.as_py(), known))
            grid = np.array(table, float).reshape(len(table), len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array([len(p[0]) for p in text_parts], pa.int64()),
                 *(pa.array([p[i] for p in text_parts], pa.string()) for i in range(3)), *(pa.array(grid[:, i]) for i in range(len(FEATURES)))],
                ["doc_id", "start", "size", "value", "before", "after", *FEATURES],
            )

    features = ", ".join(f"{f} double" for f in FEATURES)
    return rows.mapInArrow(run, f"doc_id {kind}, start long, size long, value string, before string, after string, {features}")


def format_labels() -> Column:
    """Labels of findings whose format settles them: 1 secret, 0 not, null unsettled.

    Issued key formats, bodies of private keys, passwords in URLs, and hexadecimal values
    assigned to a credential's name, are secrets.
    So are values of eight or more letters and digits, with or without marks, assigned to one.
    Numbers that are digits only, values of letters only that the dictionary explains, and
    hexadecimal digests and UUIDs after a name of such, are not.
    """
    issued = F.col("value").rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") | F.col("value").rlike("^(ghp|gho|ghs)_[A-Za-z0-9]{36}$")
    named = F.col("before").rlike("(?i)(password|passwd|pwd|token|secret|key)\\s*[=:]\\s*[\"']?$") & F.col("value").rlike("^[0-9a-fA-F]{16,}$")
    number = F.col("value").rlike("^[0-9]+$")
    word = F.col("value").rlike("^([A-Z]?[a-z]+|[A-Z]+)$") & (F.col("dictionary") >= 0.5) & ~F.col("before").rlike("[=:]\\s*[\"']?$")
    assigned = F.col("before").rlike("(?i)(password|passwd|pwd|token|secret)[\"']?\\s*[=:]\\s*[\"']?$")
    strong = assigned & F.col("value").rlike("^(?=.*[0-9])(?=.*[A-Za-z]).{8,}$")
    digest = F.col("value").rlike("^([0-9a-fA-F]{32,128}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$") & F.col("before").rlike(
        "(?i)(sha-?[0-9]*(sum)?|md5(sum)?|commit|checksum|digest|uuid)[\"']?\\s*[=: ]\\s*[\"']?$")
    placed = F.col("before").rlike("(PRIVATE KEY-----\\s*|://[^\\s:/@]+:)$")
    return F.when(issued | named | strong | placed, 1).when(number | word | digest, 0)


def train(findings: DataFrame, max_rows: int = 20_000, trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel | None:
    """A random forest from labelled findings: ``FEATURES`` and ``label`` (0 or 1; null rows are left out).

    Fitted on a bounded sample, the ``max_rows`` findings of smallest hash. None if a label is missing.
    """
    sample = findings.where("label IS NOT NULL").select(*FEATURES, F.col("label").cast("double").alias("label"))
    sample = cut_lineage(sample.orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(max_rows))
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32, featuresCol="features", labelCol="label")
    return forest.fit(_assembled(sample))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def scan(
    docs: DataFrame, labels: Column | None = None, learn_from: Column | None = None, threshold: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
) -> DataFrame:
    """Candidates of all documents and whether they are secrets: ``doc_id, start, length, digest, score, predicted, label``.

    ``labels`` is an expression over the candidate's columns, by default ``format_labels``;
    ``learn_from`` one over ``doc_id`` that says which documents' findings train the forest (all by
    default). ``digest`` is the SHA-256 of the value, which itself is not given out. Without
    labelled findings of both kinds every score is null and nothing is predicted. Null and empty
    texts have no candidates; rows of one id are scanned as they stand.
    """
    known = dictionary(docs, text_col=text_col)
    found = candidates(docs, known, id_col, text_col, path_col)
    found = cut_lineage(found.withColumn("label", format_labels() if labels is None else labels))
    model = train(found if learn_from is None else found.where(learn_from))
    if model is None:
        scored = found.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(_assembled(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "start", F.col("size").alias("length"), F.sha2("value", 256).alias("digest"), "score",
        F.coalesce((F.col("score") >= threshold).cast("int"), F.lit(0)).alias("predicted"), F.col("label").cast("int").alias("label"),
    )


def redacted(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with predicted secrets replaced by ``mark``; columns as before. Needs unique ids."""
    spans = findings.where("predicted = 1").groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("__spans"))
    joined = docs.join(spans, F.col(id_col) == F.col("__id"), "left")
    # From the last span to the first, so that earlier places stay.
    cut = F.aggregate(
        F.reverse("__spans"), F.col(text_col),
        lambda text, s: F.concat(F.substring(text, F.lit(1), s["start"].cast("int")), F.lit(mark), F.substring(text, (s["start"] + s["length"] + 1).cast("int"), F.length(text))),
    )
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut)).select(docs.columns)
