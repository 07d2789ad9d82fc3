"""Files that nobody wrote by hand here: generated, minified, vendored, or data kept as code.

A random forest is trained on what a file looks like beside the others of its language: how well it compresses, the entropy of its
tokens, the length of its identifiers, how much of it is comment, how lines repeat, and also what its path suggests and in
how many projects the same text lies. The labels come from notices in the head of some files, which the features never see. Files with a
notice are known by it; the forest alone decides on all others, at one threshold that held-out labels set.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codestrata.tables import materialize, spread

TREES, DEPTH, SEED = 100, 6, 7
LEVELS = [i / 32 for i in range(33)]  # quantiles of the labelled files of either kind at which a tree may split, least and greatest value among them
PART = 8192  # labelled files a partition in training
LANGUAGE_FILES = 30  # files of a language from which it has medians of its own; those of rarer ones are taken from all files
OWN_WEIGHT = 3.0  # how much the labelled files of the project's own weigh in training beside all other labelled ones, since most files are hand-written
FALSE_ALARMS = 0.0005  # share of held-out files of the project's own that may lie above the threshold

# Notices by which tools and authors mark files.
_GENERATED = re.compile(
    r"(?i)\bcode generated by\b|(?<![\w@])@generated\b|\bauto(?:matically)?[- ]?generated\b|\bgenerated by\b|\bdo not (?:edit|modify)\b"
    r"|\b(?:manual|your) changes (?:are|will be) lost\b|\bedits will be (?:overwritten|lost)\b|\bnicht von hand ändern\b|\bautomatisch erzeugt\b"
    r"|\bmachine[- ](?:made|generated)\b|\bautogenerated on build\b|\boutput of `[^`]+`|\bfichier généré\b|\bne pas modifier\b|自动生成|请勿手动修改|\bno editar\b|\bgerado automaticamente\b|не редактировать|сгенерирован|\bthis file was (?:produced|generated|created) by\b")
_BUNDLE = re.compile(r"(?i)^\W*\w+ bundle\W*$|sourceMappingURL=")
_VENDORED = re.compile(
    r"(?i)^\W*@license\s+\S+\s+v?\d|^\W*upstream:\s*\S+|^\W*this file is part of \S+ \(v?\d|^\W*\S+ v?\d+\.\d[\w.]*\s*\|\s*\(c\)|\bcopyright (?:the )?\S+ authors\b")
_DATA = re.compile(r"(?i)^\W*\w+ (?:samples|glyphs|lookup|table|weights|font|payload)\W*$")
_OWN = re.compile(r"(?i)\bproject team\b|\binternal use\b|\b(?:maintained|tuned|written) by hand\b|\bhand-tuned\b|\bnot generated any more\b|\bonce generated\b")
_QUOTED = re.compile(r"[\"'].*$|^.*?\b(?:writes|emits|prints|checks for|looks for)\b.*$", re.I)

# What paths of such files look like.
GENERATED_PATH = (r"(?i)(_pb2?(_grpc)?|\.pb|\.pb\.(gw|validate)|\.gen|\.g|\.generated|\.designer|\.tab|\.freezed|_generated|zz_generated.*)\.[a-z]+$"
                  r"|grpc\.[a-z]+$|(^|/)moc_[^/]*$|(^|/)(generated|autogen|__generated__|gen-src|gensrc)/")
VENDOR_PATH = r"(?i)(^|/)(vendor|vendored|third[_-]?party|3rdparty|externals?|extern|node_modules|deps|bower_components|site-packages)/"
MINIFIED_PATH = r"(?i)([.-]min\.[a-z]+$)|(\.[0-9a-f]{8,}\.[a-z]+$)|(\.bundle\.[a-z]+$)|(^|/)dist/"

FEATURES = ["log_size", "log_lines", "mean_line", "max_line", "compression", "token_entropy", "line_repeat", "identifier_length",
            "short_identifiers", "comment_density", "digits", "literals", "blanks", "numbers", "generated_path", "vendor_path", "minified_path", "copies"]
_COLUMNS = FEATURES[:14]
RELATIVE = _COLUMNS[2:]  # taken as the difference from the language's median

_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\S")
_LITERAL = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|endif|else|pragma|undef|error)|/\*|\*|--|;|%|<!--|\"\"\"|''')")
_STRIP = re.compile(r"/\*.*?\*/|(?m:^\s*(?://|#(?!include|define|if|endif|else|pragma|undef|error)|--).*$)|\"\"\".*?\"\"\"", re.S)


def split_head(text: str) -> tuple[str, str]:
    """The comment block that opens a file, and the rest."""
    at, inside = 0, False
    for line in text.splitlines(keepends=True):
        s = line.strip()
        if inside:
            inside = "*/" not in s
        elif s.startswith("/*") and "*/" not in s:
            inside = True
        elif s.startswith(("/*", "<!--")) and s.endswith(("*/", "-->")):
            pass
        elif s and not (_COMMENT.match(line) and not s.startswith(('"""', "'''", "*"))) and s != "﻿" and not s.startswith("#!"):
            break
        at += len(line)
    return text[:at], text[at:]


def notice(head: str, text: str) -> str | None:
    """'generated', 'minified', 'vendored', 'data' or 'own' by what the head says; None where it says nothing.

    Notices in quotation marks, and lines telling what the file itself writes, are talk about notices.
    """
    for line in head.splitlines():
        if _OWN.search(line):
            return "own"
        bare = _QUOTED.sub("", line)
        if _GENERATED.search(bare):
            return "generated"
        if _VENDORED.search(bare):
            return "vendored"
        if _BUNDLE.search(bare):
            return "minified"
        if _DATA.search(bare):
            return "data"
    last = text.rstrip()
    return "minified" if last.find("sourceMappingURL=", last.rfind("\n") + 1) >= 0 else None


def body_key(body: str) -> str:
    """A text's code without comments and white space, for finding copies whose headers or layout differ."""
    return re.sub(r"\s+", "", _STRIP.sub("", body))


def features(body: str) -> tuple[float, ...]:
    """The features of a text without its head, in the order of FEATURES up to the path's."""
    n = max(1, len(body))
    lines = body.splitlines() or [""]
    full = [x for x in (line.strip() for line in lines) if x]
    raw = body.encode("utf-8", "replace")
    tokens = _TOKEN.findall(body)
    counts = Counter(tokens)
    total = max(1, len(tokens))
    entropy = math.log2(total) - sum(c * math.log2(c) for c in counts.values()) / total
    words = numbers = length = short = 0
    for t, c in counts.items():
        if t[0].isdigit():
            numbers += c
        elif t[0].isalpha() or t[0] == "_":
            words += c
            length += c * len(t)
            short += c * (len(t) == 1)
    digits = sum(map(body.count, "0123456789"))
    shapes = {re.sub(r"\d+", "0", x) for x in full}
    blanks = body.count(" ") + body.count("\n") + body.count("\t") + body.count("\r")
    comments = sum(1 for x in lines if _COMMENT.match(x))
    return (
        math.log1p(len(body)), math.log1p(len(lines)), n / len(lines), math.log1p(max(map(len, lines))),
        len(zlib.compress(raw, 3)) / max(1, len(raw)), entropy, 1 - len(shapes) / max(1, len(full)), length / max(1, words), short / max(1, words),
        comments / len(lines), digits / n, sum(map(len, _LITERAL.findall(body))) / n, blanks / n, numbers / total)


def _extract(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for b in rows:
        out = []
        for k, text in zip(b["file_id"], b["text"]):
            text = text or ""
            head, body = split_head(text)
            code = body_key(body)
            out.append((k, notice(head, text), xxhash.xxh3_64_intdigest(code) - (1 << 63) if code else None, not text.strip(), *features(body)))
        yield pd.DataFrame(out, columns=["file_id", "notice", "copy_key", "empty", *_COLUMNS]).astype({"copy_key": "Int64"})


def file_features(files: DataFrame, texts: DataFrame) -> DataFrame:
    """One row a file: project, path, notice and the features. What is extracted from texts is joined, never the texts.

    A file without a text row, or with a null text, counts as empty and has neither notice nor copies. Features of wording and layout are differences from the median
    of the files of the same extension, since what is odd in one language is normal in another; null extensions go together.
    """
    schema = "file_id long, notice string, copy_key long, empty boolean, " + ", ".join(f"{c} double" for c in _COLUMNS)
    found = spread(texts.where("file_id IS NOT NULL").select("file_id", "text")).mapInPandas(_extract, schema)
    known = files.select("file_id", "project", "path", "ext").where(F.col("file_id").isNotNull()).dropDuplicates(["file_id"])
    rows = materialize(known.join(found, "file_id", "left").withColumn("language", F.lower(F.coalesce("ext", F.lit("")))), "file-features")
    copies = rows.where(F.col("copy_key").isNotNull()).select("copy_key", "project").distinct().groupBy("copy_key").agg(F.count("*").alias("holders"))
    flag = lambda pattern: F.coalesce(F.col("path").rlike(pattern), F.lit(False)).cast("double")
    filled = rows.where("NOT empty")
    medians = [F.percentile_approx(c, 0.5, 1000).alias(f"median_{c}") for c in RELATIVE]
    usual = filled.groupBy("language").agg(F.count("*").alias("n"), *medians).where(F.col("n") >= LANGUAGE_FILES).drop("n")
    overall = filled.agg(*medians).first()  # one row
    out = rows.join(copies.where("holders > 1"), "copy_key", "left").join(usual, "language", "left")
    return (
        out.withColumns({c: F.col(c) - F.coalesce(F.col(f"median_{c}"), F.lit(overall[f"median_{c}"] or 0.0)) for c in RELATIVE} | {
            "generated_path": flag(GENERATED_PATH), "vendor_path": flag(VENDOR_PATH), "minified_path": flag(MINIFIED_PATH),
            "copies": F.log1p(F.coalesce("holders", F.lit(1)).cast("double")), "empty": F.coalesce("empty", F.lit(True))})
        .na.fill(0.0, _COLUMNS).select("file_id", "project", "path", "ext", "notice", "empty", *FEATURES))


def _coder(labelled: DataFrame):
    """A function that adds ``features``: of each feature the number of its bin. Bins are cut by quantiles of all labelled files of either kind, halfway between the values on either side."""
    from pyspark.ml.feature import Bucketizer, VectorAssembler

    codes = [f"code_{c}" for c in FEATURES]
    binned = lambda cuts: Bucketizer(splitsArray=[[-math.inf, *c, math.inf] for c in cuts], inputCols=FEATURES, outputCols=codes)
    kinds = labelled.groupBy("label").agg(*(F.percentile_approx(c, LEVELS, 10_000).alias(c) for c in FEATURES)).collect()  # two rows of at most 33 values a feature
    values = binned([sorted({v for r in kinds for v in r[c]}) for c in FEATURES]).transform(labelled).select(F.posexplode(F.array(*(F.struct(F.col(c).alias("v"), F.col(f"code_{c}").alias("bin")) for c in FEATURES))))
    ends = [[] for _ in FEATURES]
    for r in sorted(values.groupBy("pos", "col.bin").agg(F.min("col.v").alias("low"), F.max("col.v").alias("high")).collect()):  # at most 67 rows a feature
        ends[r["pos"]].append((r["low"], r["high"]))
    middle = lambda below, above: at if (at := (below + above) / 2) > below else above
    to_codes = binned([[middle(x[1], y[0]) for x, y in zip(e, e[1:])] or [0.0] for e in ends])
    to_vector = VectorAssembler(inputCols=codes, outputCol="features")
    return lambda rows: to_vector.transform(to_codes.transform(rows).withColumns({c: F.col(c).cast("int") for c in codes})).drop(*codes)  # without the cast they'd count as categories


def _forest(coded: DataFrame, n: int):
    """A function that adds the forest's ``probability``, after training on all ``n`` rows, laid out by file so that it is the same forest whatever the partitions.

    Trees look for splits in a sample of maxBins squared rows unless there are fewer, so maxBins is the root of the rows; codes have few values, so that no feature gets more bins for it.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    laid = coded.repartition(-(-n // PART), "file_id").sortWithinPartitions("file_id")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2, featureSubsetStrategy="sqrt", weightCol="weight", maxBins=max(2 * len(LEVELS) + 1, math.isqrt(n) + 1)).fit(laid)
    return lambda rows: forest.transform(rows).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def classify(rows: DataFrame) -> tuple[DataFrame, float]:
    """``rows`` with the forest's probability, and the threshold: half of the votes, or more where held-out files of the project's own come higher.

    The forest is trained on all files with a notice. For the threshold another one is trained on half of them, by hash, and asked about
    the other half. Where there are not labels of both kinds, the probability is 0.
    """
    labelled = materialize(
        rows.where(F.col("notice").isNotNull() & ~F.col("empty")).withColumn("label", (F.col("notice") != "own").cast("double"))
        .select("file_id", "label", F.pmod(F.xxhash64("file_id", F.lit(SEED)), F.lit(2)).alias("half"), *FEATURES), "labelled")
    kinds = {(r["half"], r["label"]): r["count"] for r in labelled.groupBy("half", "label").count().collect()}  # at most four
    n = [sum(c for (_, label), c in kinds.items() if label == kind) for kind in (0.0, 1.0)]
    if not all(n):
        return rows.withColumn("probability", F.lit(0.0)), 0.5
    code = _coder(labelled)
    coded = code(labelled).withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(OWN_WEIGHT * n[1] / n[0])).select("file_id", "label", "half", "weight", "features")
    threshold = 0.5
    if len(kinds) == 4:
        held = _forest(coded.where("half = 0"), kinds[0, 0.0] + kinds[0, 1.0])(coded.where("half = 1 AND label = 0")).select("probability")
        threshold = max(threshold, held.orderBy(F.desc("probability")).limit(int(kinds[1, 0.0] * FALSE_ALARMS) + 1).agg(F.min("probability")).first()[0])
    return _forest(coded, sum(n))(code(rows)), threshold


def not_handwritten(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, notice, probability) of the files that aren't hand-written.

    A file with a notice is what its notice says, which is what the forest learns from; of all others those come out that the forest gives a probability above
    the threshold of :func:`classify`. Empty files, and the project's own markdown, never do. Repeated rows count once; a null path or extension gives no hint.
    """
    rows, threshold = classify(file_features(files, texts))
    markdown = F.coalesce(F.lower("ext").isin(".md", ".markdown"), F.lit(False)) | F.coalesce(F.col("path").rlike(r"(?i)\.(md|markdown)$"), F.lit(False))
    own_text = markdown & (F.col("vendor_path") == 0)
    return (
        rows.where(~F.col("empty") & ~own_text)
        .where(F.when(F.col("notice").isNull(), F.col("probability") > threshold).otherwise(F.col("notice") != "own"))
        .select("file_id", "notice", "probability"))
