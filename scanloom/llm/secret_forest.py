"""Secret scans with a random forest that removes false positives, in DataFrame functions and the JVM's forest only.

Candidates are runs of 16 or more characters of keys and tokens, and all that the
secret patterns find: tokens, and values of any length and characters in quotes that
are assigned to a name of secrets. Each gets numbers
for its length and characters, the transitions between its characters, how much of
it the corpus' dictionary covers, its path, and the words beside it. A forest is
fitted on labelled findings and gives each candidate the probability of a secret.
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.patterns import ASSIGN_HINT, GENERIC_JS, GENERIC_PY, TOKEN_PATTERNS
from scanloom.llm.common import measured, settle

CHARACTERS = "A-Za-z0-9_+/="
LEAST_LENGTH = 16
CANDIDATE = rf"(?<![{CHARACTERS}\-])[{CHARACTERS}\-]{{{LEAST_LENGTH},}}+"
WHOLE_RUN = rf"^[{CHARACTERS}\-]{{{LEAST_LENGTH},}}$"
#: A token, and a value with its name and quotes.
TOKEN = "|".join(f"(?:{p.regex})" for p in TOKEN_PATTERNS)
TOKEN_HINT = "|".join(p.hint for p in TOKEN_PATTERNS)
QUOTED = r"""["']([^"']{1,})["']"""
ASSIGNMENT = "|".join(f"(?:{p.regex})" for p in (GENERIC_JS, GENERIC_PY))
ASSIGNED_TO = "|".join(f"(?:{p.regex.removesuffix(QUOTED)}[\"']$)" for p in (GENERIC_JS, GENERIC_PY))
#: Characters before and after a candidate that count as beside it.
BEFORE, AFTER = 48, 16
#: A word is in the dictionary if it occurs so often in the corpus.
DICTIONARY_COUNT = 5
#: Bound of the sample that the forest is fitted on: labelled findings of each label.
SAMPLE = 10_000
TREES, DEPTH, SEED = 24, 8, 7
THRESHOLD = 0.5
#: Words that stand before secrets, words of stand-ins, parts of paths of tests and of settings.
SECRET_WORDS = "token|secret|passw|pwd|apikey|api_key|api-key|auth|credential|access|private"
STAND_IN_WORDS = "example|sample|dummy|placeholder|changeme|your|xxxx|test"
TEST_PATHS = r"(^|[/._-])(tests?|examples?|samples?|mocks?|fixtures?|docs?)([/._-]|$)"
SETTING_PATHS = r"\.(env|ini|cfg|conf|toml|ya?ml|json|properties)$"
ASSIGNED = rf"(?i)({SECRET_WORDS})\w*[\"']?\s*(:|=|:=|=>)\s*[\"']?$"
FLOOR = -9.0

FEATURES = [
    "size", "digit_share", "upper_share", "other_share", "distinct_share", "entropy", "hex_only", "class_changes", "letter_flow", "dictionary_share",
    "path_depth", "path_test", "path_setting", "secret_words", "stand_in_words", "assigned", "quoted",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, number, candidate, before, after): each candidate of each whole text; number counts those of a text from 0.

    First come the long runs, then assigned values, then tokens, each in the order of
    the text; what is a long run or an assigned value as a whole comes only once.
    """
    text = F.col(text_col).cast("string")
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), text.alias("text"))
    for name, regex, hint in (("run", CANDIDATE, None), ("value", ASSIGNMENT, ASSIGN_HINT), ("token", TOKEN, TOKEN_HINT)):
        found = F.regexp_extract_all("text", F.lit(regex), 0)
        split = split.withColumn(name, found if hint is None else F.when(F.col("text").rlike(hint), found))
    split = split.where("size(run) > 0 or size(value) > 0 or size(token) > 0")
    for name, regex in (("run", CANDIDATE), ("value", ASSIGNMENT), ("token", TOKEN)):
        split = split.withColumn(f"{name}_between", F.when(F.size(name) > 0, F.split("text", regex, -1)))

    def place(candidate: Column, before: Column, after: Column) -> Column:
        return F.struct(candidate.alias("candidate"), F.right(before, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"))

    def beside(name: str, of=lambda found, before, after: place(found, before, after)) -> Column:
        made = F.transform(name, lambda c, i: of(c, F.get(f"{name}_between", i), F.get(f"{name}_between", i + 1)))
        return F.coalesce(made, F.array().cast("array<struct<candidate:string,before:string,after:string>>"))

    def value(found: Column, before: Column, after: Column) -> Column:
        named = F.regexp_extract(found, r"""^[^"']*["']""", 0)
        inner = F.substring(found, F.length(named) + 1, F.length(found) - F.length(named) - 1)
        return place(inner, F.concat(before, named), F.concat(F.right(found, F.lit(1)), after))

    def is_run(c: Column) -> Column:
        return c["candidate"].rlike(WHOLE_RUN) & ~c["before"].rlike(rf"[{CHARACTERS}\-]$") & ~c["after"].rlike(rf"^[{CHARACTERS}\-]")

    def token(found: Column, before: Column, after: Column) -> Column:
        whole = before.rlike(ASSIGNED_TO) & after.rlike("^[\"']") & F.array_contains(F.transform("value", lambda c: c["candidate"]), found)
        return F.when(~whole, place(found, before, after))

    split = split.withColumn("value", beside("value", value))
    split = split.withColumn("token", F.filter(beside("token", token), lambda c: c.isNotNull() & ~is_run(c))).withColumn("run", beside("run"))
    split = split.withColumn("value", F.filter("value", lambda c: ~is_run(c)))
    every = F.concat("run", "value", "token")
    return split.select("doc_id", "path", F.inline(F.transform(every, lambda c, i: F.struct(i.alias("number"), c["candidate"].alias("candidate"), c["before"].alias("before"), c["after"].alias("after")))))


def dictionary(docs: DataFrame, text_col: str = "text", least: int = DICTIONARY_COUNT) -> DataFrame:
    """(word, n): the words, runs of letters in lower case, that occur at least ``least`` times in all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter_flow(words: DataFrame) -> dict[str, float]:
    """By pair of letters a to z: the logarithm of the second one's share after the first in the dictionary's words; 676 entries at most."""
    each = F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")
    pairs = words.where(F.length("word") > 1).select("n", F.explode(each).alias("pair"))
    counts = pairs.where(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    totals: dict[str, int] = {}
    for r in counts:
        totals[r["pair"][0]] = totals.get(r["pair"][0], 0) + r["n"]
    return {r["pair"]: log(r["n"] / totals[r["pair"][0]]) for r in counts}


def _share(pattern: str) -> Column:
    return (F.length("candidate") - F.length(F.regexp_replace("candidate", pattern, ""))) / F.length("candidate")


def features(found: DataFrame, words: DataFrame, flow: dict[str, float]) -> DataFrame:
    """``found``, a written table with the column candidate_id, with the numbers of FEATURES."""
    runs = found.select("candidate_id", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), 0)).alias("word"))
    needed = settle(runs.select("word").distinct(), "runs")
    known = settle(words.join(measured(needed), "word", "left_semi").select("word"), "runs")
    covered = settle(runs.join(measured(known), "word", "left_semi").groupBy("candidate_id").agg(F.sum(F.length("word")).alias("covered")), "covered")
    table = F.create_map(*[F.lit(x) for pair in flow.items() for x in pair]) if flow else F.create_map(F.lit(""), F.lit(FLOOR))
    pairs = F.expr("transform(sequence(1, length(candidate) - 1), i -> substring(candidate, i, 2))")
    letters = F.filter(F.transform(pairs, F.lower), lambda p: p.rlike("^[a-z]{2}$"))
    mean = F.aggregate(letters, F.lit(0.0), lambda s, p: s + F.coalesce(F.element_at(table, p), F.lit(FLOOR))) / F.size(letters)
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "_+/=-", "-----")
    changes = F.length("candidate") - F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    each = F.array_distinct(F.split("candidate", ""))
    parts = F.transform(F.filter(each, lambda c: c != ""), lambda c: (F.length("candidate") - F.length(F.replace(F.col("candidate"), c, F.lit("")))) / F.length("candidate"))
    made = found.join(covered, "candidate_id", "left").withColumns({
        "size": F.length("candidate").cast("double"),
        "digit_share": _share("[0-9]"),
        "upper_share": _share("[A-Z]"),
        "other_share": _share("[_+/=-]"),
        "distinct_share": F.size(F.filter(each, lambda c: c != "")) / F.length("candidate"),
        "entropy": F.aggregate(parts, F.lit(0.0), lambda s, p: s - p * F.log2(p)),
        "hex_only": F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "class_changes": 1 - changes / F.length("candidate"),
        "letter_flow": F.when(F.size(letters) > 0, mean).otherwise(FLOOR),
        "dictionary_share": F.coalesce("covered", F.lit(0)) / F.length("candidate"),
        "path_depth": F.size(F.split("path", "/")).cast("double"),
        "path_test": F.lower("path").rlike(TEST_PATHS).cast("double"),
        "path_setting": F.lower("path").rlike(SETTING_PATHS).cast("double"),
        "secret_words": F.regexp_count(F.lower("before"), F.lit(SECRET_WORDS)).cast("double"),
        "stand_in_words": F.regexp_count(F.lower(F.concat("before", "candidate", "after")), F.lit(STAND_IN_WORDS)).cast("double"),
        "assigned": F.col("before").rlike(r"[:=]\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
    })
    return made.drop("covered")


def weak_label() -> Column:
    """A label for a finding where none is given: 1 if it is assigned to a name of secrets, has letters and digits and no stand-in's name; else 0."""
    mixed = F.col("candidate").rlike("[A-Za-z]") & F.col("candidate").rlike("[0-9]")
    return (F.col("before").rlike(ASSIGNED) & mixed & ~F.lower("candidate").rlike(STAND_IN_WORDS)).cast("double")


def fit(labelled: DataFrame, sample: int = SAMPLE):
    """A forest fitted on at most ``sample`` findings of each label, dealt by a hash; None if one of the labels is missing.

    ``labelled``: FEATURES, label (0 or 1, others and null are left out), and what tells
    findings apart: doc_id, path, number and candidate. However the rows lie in files and
    partitions, the same are chosen and seen in the same order.
    """
    own = ["doc_id", "path", "number", "candidate", *FEATURES]
    order = [F.xxhash64(*own[:4], F.lit(SEED)), *own]
    parts = [labelled.where(F.col("label") == x).orderBy(*order).limit(sample) for x in (0.0, 1.0)]
    chosen = settle(parts[0].unionByName(parts[1]).select("label", *own), "sample")
    if chosen.select("label").distinct().count() < 2:
        return None
    chosen = chosen.repartition(1).sortWithinPartitions("label", *order).select("label", *FEATURES)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen))


def score(found: DataFrame, model) -> DataFrame:
    """``found`` with p_secret, the forest's probability; without a forest the label itself."""
    if model is None:
        return found.withColumn("p_secret", F.coalesce("label", F.lit(0.0)))
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    return judged.withColumn("p_secret", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", sample: int = SAMPLE) -> DataFrame:
    """A row for each candidate: doc_id, path, number, candidate, FEATURES, held_out, label, p_secret and secret.

    ``labels`` (doc_id, number, label) are labelled findings; without them the findings
    are labelled by ``weak_label``. The forest is not fitted on documents whose
    crc32(doc_id as text) modulo 4 is 2: held_out. Where findings of both labels are not
    there, the label is the verdict. A null or empty text has no candidates; a null
    doc_id is carried along and never fitted on; repeated rows give their candidates
    again. Other columns are not looked at. An empty table gives an empty table.
    """
    found = settle(candidates(docs, id_col, text_col, path_col).withColumn("candidate_id", F.monotonically_increasing_id()), "candidates")
    words = settle(dictionary(docs, text_col), "dictionary")
    numbered = features(found, words, letter_flow(words))
    if labels is None:
        labelled = numbered.withColumn("label", weak_label())
    else:
        given = labels.select("doc_id", "number", F.col("label").cast("double").alias("label"))
        labelled = numbered.join(given, ["doc_id", "number"], "left")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labelled = settle(labelled.withColumn("held_out", F.coalesce(fold, F.lit(True))), "features")
    model = fit(labelled.where("not held_out"), sample)
    judged = score(labelled, model).withColumn("secret", F.col("p_secret") >= THRESHOLD)
    return judged.select("doc_id", "path", "number", "candidate", *FEATURES, "held_out", "label", "p_secret", "secret")
