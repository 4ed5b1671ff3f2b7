"""Secret scan: a random forest tells secrets from look-alikes.

Candidates are runs of 16 or more key characters, and whatever follows = or : (of any length and punctuation up to
white space or a quote), the word after "Bearer", and the password of a URL; a name before = is no part of them. The forest judges each by its length, character
transitions, dictionary coverage, path and neighbouring words; it is trained on labelled findings. Trees become
CASE expressions, so the scan itself is DataFrame functions only, one pass without a shuffle.

Results for unusual input: null and empty texts have no findings; texts are scanned whole, however long; repeated
rows are scanned each; an empty table gives an empty table; columns of the input called like a result column are
replaced.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

_KEY = r"A-Za-z0-9_+/\-"
_QUOTE = "\"'`"
#: After a name: = or : (also => and :=), white space and a quote. Alternatives of fixed width, as Python's patterns need.
_QUOTED = rf"(?:(?<=[=:>][{_QUOTE}])|(?<=[=:>]\s[{_QUOTE}])|(?<=[=:>]\s\s[{_QUOTE}]))"
_BARE = r"(?:(?<=[=:])|(?<=[=:>]\s)|(?<=[=:>]\s\s)|(?<=[Bb]earer\s)|(?<=BEARER\s))(?!//)"
_VALUE = rf"[^\s{_QUOTE}<>;,&=:][^\s{_QUOTE}<>;,&]*+(?:&(?!\w{{1,40}}=)[^\s{_QUOTE}<>;,&]*+){{0,8}}"
#: No alternative starts after a letter or digit; the first look passes over most positions at once.
CANDIDATE = rf"(?<![A-Za-z0-9])(?:(?<=:)[^\s:/@{_QUOTE}<>]++(?=@[\w\[])|{_QUOTED}[^\s{_QUOTE}<>]++|{_BARE}{_VALUE}|(?<![{_KEY}])[{_KEY}]{{16,}}+(?:={{1,2}}(?![{_KEY}{_QUOTE}=]))?)"
#: Code points of context before and after a candidate.
BEFORE, AFTER = 40, 20
#: Candidates whose lengths are added up together.
RUN = 64
REDACTED = "[SECRET]"
#: Words whose letters count as covered by the dictionary (fixed values).
DICTIONARY = """about account address admin agent alpha animal archive article asset author backup banner base beta block board book
branch bridge browser bucket build bundle button cache camera capital center change channel chapter city class client cloud
cluster code color column comment commit common company config connect content control copy core count country course cover
custom data database date default delete deploy design detail device digital docs document domain download draft editor email
engine error event example export factory feature field file filter final first folder font form format forum frame friend
front gallery game garden group guide header health help history home host hotel house icon image import index info input
issue item journal kernel label language large layout library light link list local login machine main manager market master
media member memory message metric mobile model module monitor music name network news node note number object office online
open order output package page panel paper parent part party path payment people photo picture place plan player plugin point
policy post power press price print process product profile project public query question random range rating record region
release report request research resource result review right river room root sample school science screen script search season
section server service session shop site size small social source space sport stage standard start state station status
storage store story stream street string student style summer support switch system table target task team template test text
theme thing thread time title token tool topic track trade travel tree type update upload user value version video view
village volume water weather week widget window winter word work world year""".split()
SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|auth|bearer|credential|private|access|key)[\"']?[^\p{L}0-9]{0,5}$"
PLAIN_WORDS = r"(?i)(sha\d*|commit|hash|digest|checksum|md5|uuid|guid|isbn|version|etag|build|file|path|img|href|src|id|ref|url|page|order|invoice|number|tel|phone)[\"']?[^\p{L}0-9]{0,5}$"
FEATURES = ("size", "transitions", "digits", "capitals", "distinct", "coverage", "longest_letters", "slashes", "in_path", "secret_word", "plain_word", "assigned", "dashes", "hex", "symbols", "login")


def _features(c: Column, before: Column, after: Column) -> Column:
    """The features of a candidate in its context, as a struct of doubles."""
    size = F.length(c)
    vowel_word = F.lower(c)
    covered = size - F.length(F.regexp_replace(vowel_word, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    runs = F.regexp_extract_all(c, F.lit(r"[A-Za-z]+"), 0)
    values = {
        "size": size,
        "transitions": F.regexp_count(c, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / size,
        "digits": F.regexp_count(c, F.lit("[0-9]")) / size,
        "capitals": F.regexp_count(c, F.lit("[A-Z]")) / size,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(40)),
        "coverage": covered / size,
        "longest_letters": F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)),
        "slashes": F.regexp_count(c, F.lit("/")),
        "in_path": (before.rlike(r"([/.\\?&]|://[^\s]*)$") | after.rlike(r"^([/.\\]\w|[?&])")).cast("double"),
        "secret_word": before.rlike(SECRET_WORDS).cast("double"),
        "plain_word": before.rlike(PLAIN_WORDS).cast("double"),
        "assigned": before.rlike(r"[=:]\s{0,2}[\"'`]?$").cast("double"),
        "dashes": F.regexp_count(c, F.lit("[-_]")) / size,
        "hex": c.rlike(r"^[0-9a-f]+$").cast("double"),
        "symbols": F.regexp_count(c, F.lit(r"[^\p{L}\p{M}0-9_/+=\-]")) / size,
        "login": (before.rlike(r"://[^\s/:@]*:$") & after.rlike("^@")).cast("double"),
    }
    return F.struct(*(values[n].cast("double").alias(n) for n in FEATURES))


def labelled_findings(n: int = 8000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """Labelled findings made by rule (candidate, before, after, 1 for a secret), for lack of a recorded table."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: rng.choice(DICTIONARY)
    syllable = lambda k: "".join(rng.choice("bcdfghlmnprstvz") + rng.choice("aeiou") for _ in range(k))
    filler = lambda: " ".join(syllable(rng.randint(1, 4)) for _ in range(rng.randint(1, 5)))
    digits = string.digits
    secrets = [lambda: pick(hexa, rng.choice((32, 40, 40, 64))), lambda: pick(alnum, rng.randint(20, 64)), lambda: pick(alnum + "+/", rng.randint(27, 87)) + "=", lambda: pick(string.ascii_letters, rng.randint(16, 48)), lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16), lambda: rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-")) + pick(alnum, rng.randint(20, 36))]
    named = ("token", "secret", "api_key", "password", "auth", "access_key", "private_key", "Authorization: Bearer", "client_secret", "key")
    marks = "!.#$%&*?^~@-+"
    plain = lambda: rng.choice((word, lambda: syllable(rng.randint(1, 6)), lambda: word().capitalize(), lambda: word() + rng.choice(".)!?"), lambda: pick(digits, rng.randint(1, 4)), lambda: rng.choice(("none", "null", "true", "false", "required", "string", "public", "yes", "no", "***", "-", "(", "the", "a"))))()
    spiced = lambda k: "".join(rng.sample(pick(string.ascii_letters, k - k // 3 - 1) + pick(digits, k // 3) + rng.choice(marks), k))
    chosen = lambda: rng.choice((lambda: spiced(rng.randint(6, 24)), lambda: pick(alnum, rng.randint(8, 24)), lambda: syllable(rng.randint(2, 4)) + pick(digits, rng.randint(1, 3)) + rng.choice(marks) + pick(alnum, rng.randint(2, 5)), lambda: word().capitalize() + pick(digits, rng.randint(2, 4)) + rng.choice(marks) + word(), lambda: pick(hexa, rng.randint(8, 15))))()
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.15:
            name, quote = rng.choice(named), rng.choice(("\"", "'", ""))
            before, after, c, label = f"{name}{rng.choice((' = ', ': ', '=', ':'))}{quote}", quote or rng.choice((" ", "\n", "")), chosen(), 1
        elif kind < 0.2:
            c, before, after, label = chosen().replace("@", "!"), f"{rng.choice(('postgres', 'mysql', 'https', 'redis', 'amqp'))}://{syllable(2)}:", "@" + rng.choice(("host", "db.", "10.")) + syllable(2), 1
        elif kind < 0.35:
            name, quote = rng.choice((*named, "author", "Note", word(), word(), word(), syllable(2))), rng.choice(("\"", "", ""))
            before, after, c, label = f"{name}{rng.choice((' = ', ': ', ': ', '=', ':'))}{quote}", quote or rng.choice((" ", "\n", "")), plain(), 0
        elif kind < 0.4:
            c, before, after = rng.choice((
                lambda: (syllable(2), rng.choice(("mailto:", "Email:")), "@" + syllable(3)),
                lambda: (f"{rng.randint(0, 59):02d}" + rng.choice(("", f":{rng.randint(0, 59)}", "pm")), f"{rng.randint(1, 12)}:", " "),
                lambda: (chosen(), f"{rng.choice(('id', 'version', 'href', 'src', 'file', 'page', 'ref', 'number'))}{rng.choice(('=', ': ', '=' + chr(34)))}", " "),
                lambda: (f"{syllable(2)}@{syllable(2)}.org", "contact: ", " "),
                lambda: ("/".join(word() for _ in range(rng.randint(2, 4))), rng.choice(("href=\"", "src=\"/", "url: ")), "\""),
                lambda: (syllable(rng.randint(8, 400)), rng.choice((" ", "")), rng.choice((" ", "."))),
                lambda: ("".join(word().capitalize() for _ in range(rng.randint(3, 5))), rng.choice((" ", "#", ".")), rng.choice((" ", "("))),
                lambda: (rng.choice("-_=/+") * rng.randint(16, 60), rng.choice((" ", "\n")), "\n"),
                lambda: (rng.choice("_-/").join(rng.choice((word, lambda: syllable(3)))() for _ in range(rng.randint(3, 6))), rng.choice((" ", "/", ".com/", "(")), rng.choice((" ", "/", ".html"))),
            ))()
            label = 0
        elif kind < 0.7:
            c, name = rng.choice(secrets)(), rng.choice(named)
            before, after = rng.choice((f"{name} = \"", f"{name}: ", f"{name}=", f"'{name}': '", f"{name} ", f"{name.upper()}=")), rng.choice(("\"", "'", "", "\n", ";", "\"###", "\"$$$", ","))
            if rng.random() < 0.1:
                before = " "
            label = 1
        else:
            kind, label = rng.randrange(8), 0
            c, before, after = {
                0: lambda: (pick(hexa, rng.choice((32, 40, 64))), rng.choice(("commit ", "sha256: ", "md5 = ", "checksum ", "etag \"")), " "),
                1: lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), rng.choice(("id: ", "uuid=", " ", "ref ")), " "),
                2: lambda: ("/".join(word() for _ in range(rng.randint(2, 5))) + "/" + pick(digits, rng.randint(1, 4)), rng.choice((".com/", "://", " /", " ")), rng.choice((".html", "?", " "))),
                3: lambda: ("_".join(word() for _ in range(rng.randint(2, 4))) + "_" + pick(digits, rng.randint(1, 3)), rng.choice((" ", "= ", "(")), rng.choice((" ", "(", ")"))),
                4: lambda: (pick(digits, rng.randint(16, 19)), rng.choice((" ", "number ", "order: ", "tel ")), " "),
                5: lambda: ("-".join(syllable(rng.randint(2, 4)) for _ in range(rng.randint(2, 5))) + "-" + pick(digits, rng.randint(1, 6)), rng.choice(("/", " ", ".org/")), rng.choice((".jpg", "/", " "))),
                6: lambda: (f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}-{word()}{rng.randint(1, 99)}", " ", " "),
                7: lambda: (syllable(rng.randint(7, 14)) + str(rng.randint(1, 99)), " ", rng.choice((" ", ",", "."))),
            }[kind]()
        if c:
            out.append((c, f"{filler()} {before}"[-BEFORE:], after, label))
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as nested tuples (feature, threshold, at most, above) with probabilities as leaves."""

    trees: tuple

    def probabilities(self, features: Column) -> Column:
        """The probability of each struct of features in an array."""
        return F.transform(features, lambda f: sum((self._column(t, f) for t in self.trees[1:]), self._column(self.trees[0], f)) / len(self.trees))

    def _column(self, tree, f: Column) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        feature, threshold, low, high = tree
        return F.when(f[FEATURES[feature]] <= threshold, self._column(low, f)).otherwise(self._column(high, f))

    def sql(self, of: str) -> str:
        return "(" + " + ".join(self._case(t, of) for t in self.trees) + f") / {len(self.trees)}"

    def _case(self, tree, of: str) -> str:
        if isinstance(tree, float):
            return f"{tree!r}D"
        feature, threshold, low, high = tree
        return f"CASE WHEN {of}.{FEATURES[feature]} <= {threshold!r}D THEN {self._case(low, of)} ELSE {self._case(high, of)} END"

    def probability(self, features: np.ndarray) -> float:
        return float(np.mean([self._walk(t, features) for t in self.trees]))

    def _walk(self, tree, x: np.ndarray) -> float:
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree


def grow(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, leaf: int = 5, seed: int = 11) -> Forest:
    """A random forest: bootstrap rows, a random third of the features at each split, Gini impurity."""
    rng = np.random.default_rng(seed)

    def split(own: np.ndarray, left: int):
        share = float(y[own].mean())
        if not left or share in (0.0, 1.0) or len(own) < 2 * leaf:
            return share
        best = (1.0, None, None)
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            order = own[np.argsort(x[own, f], kind="stable")]
            v, good = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            p, q = good[:-1] / n, (good[-1] - good[:-1]) / (len(order) - n)
            impurity = (n * p * (1 - p) + (len(order) - n) * q * (1 - q)) / len(order)
            impurity[(v[1:] == v[:-1]) | (n < leaf) | (len(order) - n < leaf)] = 1
            at = int(np.argmin(impurity))
            if impurity[at] < best[0]:
                best = (float(impurity[at]), int(f), float((v[at] + v[at + 1]) / 2))
        if best[1] is None:
            return share
        low = x[own, best[1]] <= best[2]
        return best[1], best[2], split(own[low], left - 1), split(own[~low], left - 1)

    return Forest(tuple(split(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)))


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None) -> Forest:
    """Grow the forest on labelled findings (candidate, before, after, label), a bounded list."""
    import pyarrow as pa

    columns = zip(("c", "before", "after", "label"), zip(*(findings or labelled_findings()), strict=True), strict=True)
    # a list would come from an RDD that Python workers of their own unpickle, and these stay on the executors
    rows = spark.createDataFrame(pa.table({name: list(x) for name, x in columns})).withColumn("label", F.col("label").cast("int"))
    got = rows.select(_features(F.col("c"), F.col("before"), F.col("after")).alias("f"), "label").collect()
    return grow(np.array([tuple(r["f"]) for r in got]), np.array([r["label"] for r in got], float))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions may use any number of times, in lambdas too, yet are computed once a row: the
    optimiser puts an expression of a plain projection in each place that refers to it, but not one behind a generator."""
    (step,) = fresh(df, "__step")
    made = df.withColumn(step, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return made.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"{step}.`{n}`").alias(n) for n in columns))


def with_secrets(docs: DataFrame, forest: Forest, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``secrets``: start, secret and probability of each finding, in order; and ``redacted``, the text without them.

    The work grows with the text: each candidate is judged once, and its start is the sum of the lengths before it, kept
    by blocks of ``RUN`` candidates."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("secrets", "redacted")))
    found, around, judged, lengths, blocks, bases = names = fresh(docs, "__found", "__around", "__judged", "__lengths", "__blocks", "__bases")
    whole = F.coalesce(F.col(text), F.lit(""))
    c_found, parts, p, n, sums, base = (F.col(x) for x in names)
    df = _once(docs, **{found: F.regexp_extract_all(whole, F.lit(CANDIDATE), 0)})
    any_found = F.size(c_found) > 0
    df = _once(df, **{around: F.when(any_found, F.split(whole, CANDIDATE))})
    features = F.transform(c_found, lambda c, i: _features(c, F.right(F.get(parts, i), F.lit(BEFORE)), F.left(F.get(parts, i + 1), F.lit(AFTER))))
    df = _once(df, **{judged: F.when(any_found, forest.probabilities(features)), lengths: F.when(any_found, F.transform(c_found, lambda c, i: F.length(F.get(parts, i)) + F.length(c)))})
    added = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    df = _once(df, **{blocks: F.when(any_found, F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / RUN).cast("int")), lambda b: added(F.slice(n, b * RUN + 1, F.lit(RUN)))))})
    df = _once(df, **{bases: F.transform(sums, lambda _, b: added(F.slice(sums, F.lit(1), b)))})

    def start(c: Column, i: Column) -> Column:
        return F.get(base, F.floor(i / RUN).cast("int")) + added(F.slice(n, i - i % RUN + 1, i % RUN + 1)) - F.length(c)

    listed = F.transform(c_found, lambda c, i: F.when(F.get(p, i) >= threshold, F.struct(start(c, i).alias("start"), c.alias("secret"), F.get(p, i).alias("probability"))))
    shown = F.transform(parts, lambda x, i: F.concat(x, F.when(F.get(p, i) >= threshold, REDACTED).otherwise(F.coalesce(F.get(c_found, i), F.lit("")))))
    none = F.array().cast("array<struct<start:int,secret:string,probability:double>>")
    out = _once(df, secrets=F.when(any_found, F.filter(listed, lambda x: x.isNotNull())).otherwise(none), redacted=F.when(any_found, F.array_join(shown, "")).otherwise(F.col(text)))
    return out.drop(*names)
