"""Secret scans: rules find candidates, a random forest drops false positives. All of it runs as SQL expressions.

Rules match assignments to telling names, well-known key forms and private key blocks. A candidate's features are its
length, character transitions, dictionary coverage, and words in its path and around it. The forest is grown in
numpy from labelled findings on the driver, and becomes arrays that a higher-order function walks.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

NAMES = "token|secret|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|passphrase|password|passwd|pwd|credentials?"
#: A block reaches to the next five dashes; header lines and escaped or quoted line ends are part of it.
BLOCK_REST = r"----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----(?![^-]{0,15}-----)[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]*?PRIVATE KEY-----"
BLOCKS = f"-{BLOCK_REST}"
#: No form has an upper bound: runs are possessive, so a long secret is matched to its end in linear time. An assigned
#: value is a block, or a run of characters that ends where a block begins.
RUN, DASH = "[A-Za-z0-9+/_.~!@#$%^&*=]", f"-(?!(?-i:{BLOCK_REST}))"
VALUE = f"(?-i:{BLOCKS})|(?=(?:{RUN}|{DASH}){{8}})(?:{RUN}++|{DASH})++"
ASSIGNED = rf"(?:{NAMES})[\"']?\s{{0,3}}(?::=|=>|=|:)\s{{0,3}}[\"']?({VALUE})"
#: Of several eyJ in one run of characters the first decides, so nearby ones aren't tried again.
JWT = r"eyJ(?<!eyJ[A-Za-z0-9_-]{0,60}eyJ)[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
KEYS = rf"AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36,}}+|sk_live_[A-Za-z0-9]{{16,}}+|xox[abprs]-[A-Za-z0-9-]{{10,}}+|AIza[A-Za-z0-9_-]{{35}}|{JWT}"
RULES = f"{BLOCKS}|{KEYS}|(?i:{ASSIGNED})"
#: Characters on either side of a candidate whose words count as its neighbours.
AROUND = 48
#: Candidates that are gathered at a time.
BLOCK = 256
#: Common words of placeholders and identifiers, and frequent pairs of letters in prose.
WORDS = "test example sample dummy fake mock placeholder change changeme your here insert enter replace todo none null true false undefined default value string number object secret token password passwd user name admin root guest login access private public key api auth bearer config setting required optional invalid missing expired header field param request response server client session cookie random generate".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
FALSE_HINTS = "example|sample|dummy|fake|mock|placeholder|test|tutorial|docs?|e\\.g\\.|such as|like|format|template|redacted|your"
TRUE_HINTS = "prod|production|live|deploy|export|bearer|authorization|leak|aws|login|env"
FEATURES = ["length", "digits", "upper", "symbols", "distinct", "letter_digit", "case_changes", "repeats", "prose_pairs", "dictionary", "hex_only", "known_form", "false_path", "false_near", "true_near", "closed"]
MARK = "[SECRET]"


def _collected(items: Column, state: dict[str, Column], step, kind: str) -> Column:
    """What step adds while it goes over items: step(state, item) gives the next state and an element, or null to add none.

    Elements are gathered in blocks, so that growing the array doesn't take the square of its length.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    start = F.struct(*[v.alias(k) for k, v in state.items()], none.alias("_block"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("_blocks"))

    def merge(acc, item):
        after, element = step(acc, item)
        full = F.size(acc["_block"]) >= BLOCK
        block = F.when(full, none).otherwise(acc["_block"])
        blocks = F.when(full, F.concat(acc["_blocks"], F.array(acc["_block"]))).otherwise(acc["_blocks"])
        return F.struct(*[v.alias(k) for k, v in after.items()], F.when(element.isNull(), block).otherwise(F.concat(block, F.array(element))).alias("_block"), blocks.alias("_blocks"))

    return F.aggregate(items, start, merge, lambda acc: F.flatten(F.concat(acc["_blocks"], F.array(acc["_block"]))))


def candidates(text: Column) -> Column:
    """An array of candidates in the text's order: start (from 0), found, value, before and after.

    The text is cut at its matches once; places and neighbours come from the pieces, in time with the text's length.
    """
    pieces = F.arrays_zip(F.split(text, RULES, -1).alias("part"), F.regexp_extract_all(text, F.lit(RULES), F.lit(0)).alias("found"))

    def forward(acc, z):
        start, before = acc["at"] + F.length(z["part"]), F.right(F.concat(acc["tail"], F.right(z["part"], F.lit(AROUND))), F.lit(AROUND))
        after = {"at": start + F.length(z["found"]), "tail": F.right(F.concat(before, z["found"]), F.lit(AROUND))}
        return after, F.when(z["found"].isNotNull(), F.struct(start.alias("start"), z["found"].alias("found"), before.alias("before")))

    def backward(acc, z):
        head = F.concat(F.left(z["part"], F.lit(AROUND)), F.left(F.coalesce(z["found"], F.lit("")), F.lit(AROUND)), acc["head"])
        return {"head": F.left(head, F.lit(AROUND))}, F.when(z["found"].isNotNull(), acc["head"])

    placed = _collected(pieces, {"at": F.lit(0), "tail": F.lit("")}, forward, "struct<start:int,found:string,before:string>")
    ends = F.reverse(_collected(F.reverse(pieces), {"head": F.lit("")}, backward, "string"))

    def describe(c, after):
        value = F.regexp_extract(c["found"], f"^(?i:{ASSIGNED})$", 1)
        value = F.when(value == "", c["found"]).otherwise(value)
        return F.struct(c["start"].alias("start"), c["found"].alias("found"), value.alias("value"), c["before"].alias("before"), after.alias("after"))

    return F.when(text.rlike(RULES), F.zip_with(placed, ends, describe)).otherwise(F.expr("cast(array() as array<struct<start:int,found:string,value:string,before:string,after:string>>)"))


def features(c: Column, path: Column) -> Column:
    """The candidate's numbers, in the order of FEATURES."""
    v, size = c["value"], F.greatest(F.length(c["value"]), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / size
    low = F.lower(v)
    known = c["found"].rlike(f"^(?:{KEYS}|{BLOCKS})$") | v.rlike(f"^(?:{BLOCKS})$")
    bare = F.length(F.regexp_replace(low, "|".join(sorted(WORDS, key=lambda w: (-len(w), w))), ""))
    near = lambda pattern: F.regexp_count(F.lower(F.concat_ws(" ", c["before"], c["after"])), F.lit(rf"\b(?:{pattern})\b")).cast("double")
    closed = F.substring(c["after"], 1, 1).rlike("[\"'\\s]") | (F.length(c["after"]) == 0)
    numbers = [
        size,
        share("[0-9]"),
        share("[A-Z]"),
        share("[^A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(v, ""))) / F.least(size, F.lit(40.0)),
        share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        share(r"(.)(?=\1)"),
        F.regexp_count(low, F.lit(f"(?=(?:{'|'.join(PAIRS)}))")) / size,
        (F.length(low) - bare) / size,
        v.rlike("^[0-9a-fA-F]+$").cast("double"),
        known.cast("double"),
        F.regexp_count(F.lower(F.coalesce(path, F.lit(""))), F.lit("test|example|sample|fixture|mock|docs?/|readme")).cast("double"),
        near(FALSE_HINTS),
        near(TRUE_HINTS),
        closed.cast("double"),
    ]
    return F.array(*[F.coalesce(n.cast("double"), F.lit(0.0)) for n in numbers])


def labelled_findings(n: int = 1600, seed: int = 11) -> list[dict]:
    """Findings with labels, made by rule: keys of many forms, and what rules take for keys though it is none."""
    rng = random.Random(seed)
    some = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = "abcdefghijklmnopqrstuvwxyz" + upper + "0123456789"
    syllables = "tha in er on re ti ion ed sh ou ble and or ly ha es st ver un ge che que men ar do lo".split()
    prose = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 6)))
    pad = lambda w: f"{prose()} {w} {prose()}".strip()
    name = lambda: rng.choice(["token", "secret", "api_key", "apikey", "access-key", "password", "pwd", "private_key", "TOKEN", "API_KEY"])
    out = []
    for i in range(n):
        true = i % 2 == 0
        quote, sign = rng.choice(['"', "'", ""]), rng.choice([" = ", "=", ": ", ":"])
        key = None
        if true:
            form = rng.randrange(8)
            if form <= 2:
                value = some(hexa, rng.choice([32, 40, 40, 40, 64]))
                value = value.upper() if rng.random() < 0.3 else value
            elif form == 3:
                value = some(mixed + "+/", rng.randint(20, 64))
            elif form == 4:
                value = some(mixed + "_-", rng.randint(16, 48))
            elif form == 5:
                value = some(mixed + "!@#$%^&*", rng.randint(10, 20))
            else:
                key = rng.choice([lambda: "AKIA" + some(upper + "0123456789", 16), lambda: "ghp_" + some(mixed, 36), lambda: "sk_live_" + some(mixed, 24), lambda: "xoxb-" + some("0123456789", 12) + "-" + some(mixed, 24), lambda: "AIza" + some(mixed, 35)])()
                value = key
            before, after, path = pad(rng.choice(["", "", "", "export", "prod", "login"])), prose(), rng.choice(["src0", "src7", "app/config.py", "deploy/env", ""])
        else:
            form = rng.randrange(9)
            words = rng.sample(WORDS, 3)
            value = [
                lambda: rng.choice("_-.").join(words),
                lambda: "your_" + rng.choice(words) + "_here",
                lambda: rng.choice("xX0*a1") * rng.randint(8, 40),
                lambda: rng.choice(["1234567890", "abcdefghijkl", "0123456789abcdef", "abcd1234", "qwertyuiop"]) * rng.randint(1, 2),
                lambda: "".join(rng.choices(syllables, k=rng.randint(4, 8))),
                lambda: "".join(w.capitalize() for w in words),
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
                lambda: "$" + rng.choice(words).upper() + "_" + rng.choice(words).upper(),
                lambda: "/".join(words) + rng.choice([".txt", ".json", ".py"]),
            ][form]()
            if len(value) < 8:
                value += "_" + rng.choice(WORDS) + "_key"
            before, after, path = pad(rng.choice(["", "", "example", "for instance", "test", "your"])), pad(rng.choice(["", "", "sample", "format"])), rng.choice(["src0", "src7", "tests/test_auth.py", "docs/readme", "examples/a.py", ""])
        if rng.random() < 0.08 and true:
            before = pad("example")
        found = key if key and rng.random() < 0.6 else f"{name()}{sign}{quote}{value}"
        out.append({"path": path, "found": found, "value": value, "before": (before + " ")[-AROUND:], "after": (quote + " " + after)[:AROUND], "label": int(true)})
    return out


class Forest:
    """Trees as arrays: a node has a feature, a threshold, two children and a value; leaves lead to themselves."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.value, self.roots, self.depth = [], [], [], [], [], [], 0

    def _node(self, value: float) -> int:
        self.feature.append(0)
        self.threshold.append(0.0)
        self.left.append(len(self.value))
        self.right.append(len(self.value))
        self.value.append(float(value))
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[np.arange(len(x)), np.array(self.feature)[node]] <= np.array(self.threshold)[node]
                node = np.where(low, np.array(self.left)[node], np.array(self.right)[node])
            total += np.array(self.value)[node]
        return total / len(self.roots)

    def column(self, x: Column) -> Column:
        """The forest's mean vote for a column of features, walked by higher-order functions."""
        lit = lambda values, kind: F.from_json(F.lit(json.dumps(values)), F.lit(f"array<{kind}>"))
        feature, threshold, left, right, value = lit(self.feature, "int"), lit(self.threshold, "double"), lit(self.left, "int"), lit(self.right, "int"), lit(self.value, "double")
        down = lambda node, _: F.when(F.get(x, F.get(feature, node)) <= F.get(threshold, node), F.get(left, node)).otherwise(F.get(right, node))
        leaf = lambda root: F.get(value, F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), root, down))
        return F.aggregate(lit(self.roots, "int"), F.lit(0.0), lambda acc, root: acc + leaf(root)) / len(self.roots)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 7, least: int = 4, seed: int = 5) -> Forest:
    """A random forest: each tree has a bootstrap sample, each split the best of a few random features (Gini)."""
    rng, forest = np.random.default_rng(seed), Forest()
    forest.depth = depth
    tried = max(1, int(np.sqrt(x.shape[1])) + 1)

    def split(rows: np.ndarray, level: int) -> int:
        node = forest._node(y[rows].mean())
        if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return node
        best = (np.inf, 0, 0.0)
        for f in rng.choice(x.shape[1], tried, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            cut = (v[1:] > v[:-1]) & (n >= least) & (len(order) - n >= least)
            if cut.any():
                a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(order) - n)
                cost = np.where(cut, n * a * (1 - a) + (len(order) - n) * b * (1 - b), np.inf)
                at = int(np.argmin(cost))
                if cost[at] < best[0]:
                    best = (cost[at], int(f), float((v[at] + v[at + 1]) / 2))
        if np.isfinite(best[0]):
            low = x[rows, best[1]] <= best[2]
            forest.feature[node], forest.threshold[node] = best[1], best[2]
            forest.left[node] = split(rows[low], level + 1)
            forest.right[node] = split(rows[~low], level + 1)
        return node

    for _ in range(trees):
        forest.roots.append(split(rng.integers(0, len(x), len(x)), 0))
    return forest


def train_forest(spark: SparkSession, findings: list[dict] | None = None, **options) -> Forest:
    """Grow a forest from labelled findings (path, found, value, before, after, label); features come from Spark.

    Findings are a bounded list that is given by the caller, or made by labelled_findings.
    """
    kind = "array<struct<path:string,found:string,value:string,before:string,after:string,label:int>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(findings or labelled_findings())), F.lit(kind))).alias("c"))
    got = rows.select(features(F.col("c"), F.col("c.path")).alias("x"), F.col("c.label").alias("y")).collect()
    return grow(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]), **options)


def scored(docs: DataFrame, forest: Forest, path: str | None, threshold: float, to: str = "_findings") -> DataFrame:
    """docs with a column ``to``: an array of (start, found, value, score, is_secret) for the candidates of each text."""
    where, found, judged = F.col(f"`{path}`") if path else F.lit(""), fresh(docs, "_found"), fresh(docs, "_judged")
    cast = docs.withColumn(found, candidates(F.col("text")))
    # Features are an array of their own first: within the forest's lambdas they would be computed at each node.
    seen = F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["found"].alias("found"), c["value"].alias("value"), features(c, where).alias("x")))
    told = cast.withColumn(judged, F.transform(seen, lambda c: F.struct(c["start"].alias("start"), c["found"].alias("found"), c["value"].alias("value"), forest.column(c["x"]).alias("score"))))
    return told.withColumn(to, F.transform(judged, lambda c: F.struct(c["start"], c["found"], c["value"], c["score"], (c["score"] >= threshold).alias("is_secret")))).drop(found, judged)


def secret_findings(spark: SparkSession, docs: DataFrame, forest: Forest | None = None, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, start (characters from 0), length, value_start, secret_sha256, score and is_secret of each candidate.

    start and length are those of the rule's match; the secret itself is not shown. Both what the forest keeps
    (is_secret 1) and what it drops (0) are returned. Null and empty texts have none; a null doc_id stays null and
    repeated rows are scanned each; an empty table gives no rows. ``path`` names a column with the text's path or
    source (None: no path; null: as empty). Other columns are ignored. Nothing is shuffled.
    """
    forest = forest or train_forest(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(path).cast("string").alias("_path")] if path else []))
    rows = scored(slim, forest, "_path" if path else None, threshold).select("doc_id", F.explode("_findings").alias("f"))
    return rows.select("doc_id", F.col("f.start").cast("long").alias("start"), F.length("f.found").cast("long").alias("length"), (F.col("f.start") + F.call_function("locate", F.col("f.value"), F.col("f.found")) - 1).cast("long").alias("value_start"), F.sha2(F.col("f.value").cast("binary"), 256).alias("secret_sha256"), F.round("f.score", 6).alias("score"), F.col("f.is_secret").cast("int").alias("is_secret"))


def redacted_documents(spark: SparkSession, docs: DataFrame, forest: Forest | None = None, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """All rows of docs with its columns; each secret value is replaced by MARK wherever it stands in its text.

    n_chars, where docs has it, follows the new text. Rows without secrets are as they were.
    """
    forest = forest or train_forest(spark)
    to = fresh(docs, "_findings")
    told = scored(docs, forest, path, threshold, to)
    # Longest first: a value that another one begins with or holds would break that one up, and leave its rest.
    values = F.array_distinct(F.transform(F.filter(to, lambda c: c["is_secret"]), lambda c: c["value"]))
    values = F.transform(F.reverse(F.array_sort(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))), lambda x: x["v"])
    clean = F.when(F.size(values) > 0, F.aggregate(values, F.col("text"), lambda t, v: F.replace(t, v, F.lit(MARK)))).otherwise(F.col("text"))
    out = told.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(to) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
