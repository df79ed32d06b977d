"""Secret scan whose false positives a random forest removes.

A detector takes every token with a digit or in a provider's format and every value assigned to a
credential key, eight characters or longer. Inside a token, provider formats, the user and password
of a URL, the values of a query string and the parts between colons are findings of their own; a block
of a private key is one. For each such finding the forest sees its length, its format, its character classes and transitions,
how much of it dictionary words cover, whether it is part of a path, address or number, and the
words around it. The forest (``pyspark.ml``) is trained on labelled findings: given ones, or those
of the documents themselves as ``known_label`` labels them, with made-up look-alikes; at most
``PER_LABEL`` of each label, the first by a hash of the value and its surroundings. Letter
transitions and the dictionary are counts over all words of all texts; a word is in the dictionary
from a share of ``WORD_SHARE`` of all words on, which bounds its size.

The texts are read for these counts, to find what to learn from, and to judge or redact; nothing of
them is stored. Values under ``LEAST_CHARS`` characters are no findings. A finding is judged by itself,
so the scan has no shuffle that grows with a hot document, source or value; words are counted before
their shuffle.

Edge cases: null and empty texts have no findings; repeated rows have the same findings each;
without findings of both labels the look-alikes alone train the forest; an empty table gives no
rows; ``scan`` ignores and ``redact`` keeps extra columns.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchflow.llm.tables import whole_text
from touchflow.session import released, shared_folder, stored

#: Characters of the shortest value that is looked at.
LEAST_CHARS = 8
#: Share of all words, in millionths, and times that a dictionary word occurs at least.
WORD_SHARE, WORD_TIMES = 20, 3
#: Bound of the training findings per label.
PER_LABEL = 8000
TREES, DEPTH, SEED = 24, 7, 11
MADE_UP = 150
MASK = "[secret]"

# Key words, provider formats and dictionary words.
CREDENTIAL = ("password passwd passphrase pwd pass secret token apikey api_key api-key access_key "
              "accesskey secret_key private_key client_secret auth authorization bearer credential "
              "credentials passwort contraseña clave").split()
HARMLESS = ("example sample test dummy placeholder changeme your commit sha sha1 sha256 md5 digest "
            "checksum uuid guid etag build version revision order invoice phone tel fax isbn doi id "
            "color colour hash").split()
FORMATS = {
    "aws": re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    "github": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,})"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}"),
    "stripe": re.compile(r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    "gitlab": re.compile(r"glpat-[\w-]{20,}"),
    "sendgrid": re.compile(r"SG\.[\w-]{16,}\.[\w-]{16,}"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}"),
    "jwt": re.compile(r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]+"),
    "pem": re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*-----END [A-Z0-9 ]+-----",
                      re.DOTALL),
}
DICTIONARY = ("access account admin address amount api app application article auth base build "
              "client code commit config content data date default demo dev docs email error "
              "example file first folder group header home host http https image index info input "
              "item json key last left link list local login main master message mode model name "
              "network node note number object order output page parent pass password path phone "
              "port private prod project public query release report request response result right "
              "root sample script search secret server service session setting source stage start "
              "state static status string style system table target test text time title token "
              "type update user value version view web word world www").split()

_SIGN = re.compile(r"[0-9=:]|AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|[sr]k_(?:live|test)_|eyJ|"
                   r"glpat-|SG\.|npm_")
_INSIDE = re.compile("|".join(rf"(?<![A-Za-z0-9])(?:{p.pattern})(?![A-Za-z0-9])"
                              for name, p in FORMATS.items() if name != "pem"))
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/=]{16,}")
_USER = re.compile(r"://([^\s/?#:@]*)(?::([^\s/?#]*))?@")
_PAIR = re.compile(r"(?:^|[?&#])([A-Za-z][\w.-]*)=([^&#]*)")
_STOPS = frozenset("\"'`<>(){}[],;|")
_STOP = re.compile(r"""[\s"'`<>(){}\[\],;|]""")
_ASSIGNED = re.compile(r"""\s{0,3}["'`]?([^\s"'`<>(){}\[\],;|]{8,})""")
_KEYWORD = re.compile("|".join(sorted(map(re.escape, CREDENTIAL), key=len, reverse=True)))
_HARMLESS = re.compile(r"(?<![a-z])(?:" + "|".join(HARMLESS) + r")(?![a-z])|x{4,}|\*{3,}|(.)\1{5,}")
_ADDRESS = re.compile(r"@[\w-]+(?:\.[\w-]+)+$")
_NUMBER = re.compile(r"[+(]?[\d().:,/%+-]+[a-z]{0,3}")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)

#: Marks at the end of a value that are no part of it.
_END = ".:!?=#$&*%~"

FINDING = ("start int, value string, key string, quoted boolean, before string, after string")
FEATURES = (
    "length", "digits", "upper", "lower", "other", "distinct", "entropy", "switches", "longest",
    "hexadecimal", "likely", "dictionary", "number", "address", "uuid", "slashes", "dots", "url",
    "quoted", "assigned", "credential_key", "credential_near", "harmless_near", "harmless_inside",
    "sentence", "format")


def _is_key(name: str) -> bool:
    letters = name.replace("_", "").replace("-", "").replace(".", "")
    return letters[:1].isalpha() and letters.isalnum()


def _value(text: str, begin: int, end: int) -> tuple[int, str, str]:
    """Start and text of the value in or behind a token, and the key it is assigned to."""
    token = text[begin:end]
    core = token.rstrip("=:")
    if core != token and "=" not in core and ":" not in core:  # key = "value"
        words = [core] if core else text[max(0, begin - 80):begin].split()
        key = words[-1].strip("".join(_STOPS)) if words else ""
        follow = _ASSIGNED.match(text, end)
        return (follow.start(1), follow[1], key) if follow and _is_key(key) else (begin, core, "")
    cut = max(core.rfind("="), -1 if "//" in core else core.rfind(":"))
    if cut > 0 and len(core) - cut > LEAST_CHARS and _is_key(core[:cut]):
        return begin + cut + 1, core[cut + 1:], core[:cut]
    return begin, core, ""


def _private_keys(text: str) -> list[tuple[int, int]]:
    """Begin and end of the private key blocks."""
    blocks, done, endless = [], 0, set()
    for head in _PEM.finditer(text) if "-----BEGIN " in text else ():
        if head.start() < done or head[1] in endless:
            continue
        stop = f"-----END {head[1]}-----"
        end = text.find(stop, head.end())
        if end < 0:
            endless.add(head[1])
            continue
        body = text[head.end():end].replace("\\n", " ").split()
        if 2 * sum(len(w) for w in body if _BASE64.fullmatch(w)) >= sum(map(len, body)) > 0:
            done = end + len(stop)
            blocks.append((head.start(), done))
    return blocks


def _parts(value: str, key: str) -> list[tuple[int, str, str]]:
    """Start, text and key of the candidates inside a value."""
    parts = []
    url = "://" in value
    if url:
        for hit in _USER.finditer(value):
            parts.append((hit.start(1), hit[1], ""))
            if hit[2]:
                parts.append((hit.start(2), hit[2], "password"))
    pairs = [(hit.start(2), hit[2], hit[1]) for hit in _PAIR.finditer(value)]
    parts += pairs
    if not url and not pairs and not key and ":" in value:
        at, last = 0, ""
        for piece in value.split(":"):
            parts.append((at, piece, last if _is_key(last) and _KEYWORD.search(last.lower()) else ""))
            at, last = at + len(piece) + 1, piece
    known = {(at, part.rstrip(_END)) for at, part, _ in parts}
    parts += [(hit.start(), hit[0], key if hit[0] == value else "") for hit in _INSIDE.finditer(value)
              if (hit.start(), hit[0]) not in known]
    return [(at, part.rstrip(_END), name) for at, part, name in parts]


def _candidate(value: str, key: str) -> bool:
    """Whether a part of a token is a finding: plain numbers and words of a URL are not."""
    return len(value) >= LEAST_CHARS and (
        any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        or format_of(value) is not None or _KEYWORD.search(key.lower()) is not None)


def findings(text: str) -> list[tuple[int, str, str, bool, str, str]]:
    """(start, value, key, quoted, before, after) of all candidates, in order; one that lies inside
    another follows it.

    ``key`` is what the value is assigned to; ``before`` and ``after`` are the nearest words.
    """
    found, done = [], 0
    blocks = _private_keys(text)
    for begin, end in blocks:
        found.append((begin, text[begin:end], "", begin > 0 and text[begin - 1] in "\"'`",
                      " ".join(text[max(0, begin - 60):begin].split()[-3:]),
                      " ".join(text[end:end + 40].split()[:1])))
    block = 0
    for hit in _SIGN.finditer(text):
        begin = hit.start()
        while block < len(blocks) and blocks[block][1] <= begin:
            done, block = max(done, blocks[block][1]), block + 1
        if begin < done or block < len(blocks) and begin >= blocks[block][0]:
            continue
        while begin > done and not (text[begin - 1] in _STOPS or text[begin - 1].isspace()):
            begin -= 1
        stop = _STOP.search(text, hit.start())
        end = stop.start() if stop else len(text)
        if block < len(blocks):
            end = min(end, blocks[block][0])
        begin, value, key = _value(text, begin, end)
        value = value.rstrip(_END)
        done = max(end, begin + len(value))
        if len(value) < LEAST_CHARS:
            continue
        before = " ".join(text[max(0, begin - 60):begin].split()[-3:])
        after = " ".join(text[done:done + 40].split()[:1])
        parts = {(at, part): name for at, part, name in _parts(value, key)
                 if part != value and _candidate(part, name)}
        # A token that is nothing but pairs is no value itself.
        joined = "://" not in value and "&" in value and _PAIR.match(value) and not key
        if not joined and (any(c.isdigit() for c in value) or format_of(value)
                           or _KEYWORD.search(key.lower())):
            found.append((begin, value, key, begin > 0 and text[begin - 1] in "\"'`", before, after))
        found += [(begin + at, part, name, False, before, after)
                  for (at, part), name in parts.items()]
    return sorted(found, key=lambda f: (f[0], -len(f[1])))


def format_of(value: str) -> str | None:
    return next((name for name, p in FORMATS.items() if p.fullmatch(value)), None)


def known_label(value: str, key: str, before: str, after: str) -> int | None:
    """1 for provider formats and random values of credential keys, 0 for numbers, addresses,
    identifiers and plain words, None where neither is certain."""
    around = f"{key} {before}".lower()
    if FORMATS["pem"].fullmatch(value):  # any letters may stand in its body
        return 1
    if _HARMLESS.search(value.lower()) or _UUID.fullmatch(value):
        return 0
    if format_of(value):
        return 0 if _HARMLESS.search(around) else 1
    if _NUMBER.fullmatch(value) or _ADDRESS.search(value) or "://" in value:
        return 0
    if _KEYWORD.search(key.lower()):
        return 1 if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) else None
    if _HARMLESS.search(around):
        return 0
    return 0 if sum(c.isdigit() for c in value) <= 2 else None


def made_up(count: int = MADE_UP, seed: int = SEED) -> list[tuple[int, str, str, bool, str, str]]:
    """(label, value, key, quoted, before, after): labelled look-alikes, the same for any input."""
    draw = random.Random(seed)

    def text(n: int, alphabet: str) -> str:
        return "".join(draw.choice(alphabet) for _ in range(n))

    hexa, mixed = string.digits + "abcdef", string.ascii_letters + string.digits
    rows = []
    for _ in range(count):
        word = draw.choice(DICTIONARY)
        key = draw.choice(CREDENTIAL)
        rows += [
            (1, text(40, hexa), key, True, f"{key} =", ""),
            (1, text(draw.randint(10, 24), mixed), key, draw.random() < .5, key, ""),
            (1, "AKIA" + text(16, string.ascii_uppercase + string.digits), "", False, "", ""),
            (1, "ghp_" + text(36, mixed), draw.choice(["", "token"]), draw.random() < .5, "", ""),
            (0, text(40, hexa), draw.choice(["", "commit", "sha1"]), False, "commit", ""),
            (0, text(32, hexa), draw.choice(["md5", "etag", "checksum"]), True, "md5", ""),
            (0, "-".join(text(n, hexa) for n in (8, 4, 4, 4, 12)), "id", True, "uuid", ""),
            (0, f"/{word}/{draw.choice(DICTIONARY)}{text(2, string.digits)}/{word}.html", "", False,
             "", ""),
            (0, f"https://{word}.example.com/{word}?page={text(2, string.digits)}", "", False, "", ""),
            (0, f"{word}_{draw.choice(DICTIONARY)}_{text(2, string.digits)}", "", False, "the", "of"),
            (0, draw.choice(["changeme123", "your_password1", "example-token-1", "xxxxxxxx1"]), key,
             True, key, ""),
            (0, text(draw.randint(8, 16), string.digits), "", False, "order", ""),
            (0, f"{draw.randint(1990, 2030)}-0{draw.randint(1, 9)}-{draw.randint(10, 28)}", "", False,
             "on", ""),
            (0, f"v{text(1, string.digits)}.{text(2, string.digits)}.{text(4, string.digits)}", "",
             False, "version", ""),
        ]
    for _ in range(count // 3):  # parts of URLs and of joined tokens, private keys
        key = draw.choice(CREDENTIAL)
        body = "\n".join(text(64, mixed + "+/") for _ in range(draw.randint(2, 25)))
        kind = draw.choice(["RSA ", "EC ", "OPENSSH ", ""])
        rows += [
            (1, text(draw.randint(8, 24), mixed) + text(1, string.digits), "password", False, "", ""),
            (1, text(draw.randint(16, 40), mixed), key, False, draw.choice(["", "see", "the"]), ""),
            (1, "sk_live_" + text(24, mixed), key, False, "", ""),
            (1, "ghp_" + text(36, mixed), "", False, draw.choice(["", "clone", "from"]), ""),
            (1, f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----", "",
             False, "", ""),
            (0, f"{draw.choice(DICTIONARY)}-{draw.choice(DICTIONARY)}{text(1, string.digits)}",
             draw.choice(["page", "lang", "ref", "utm_source", "q"]), False, "", ""),
            (0, f"{draw.choice(DICTIONARY)}.{draw.choice(DICTIONARY)}{text(2, string.digits)}", "",
             False, "", ""),
            (0, f"{draw.choice(DICTIONARY)}{text(1, string.digits)}.{draw.choice(DICTIONARY)}.com", "",
             False, draw.choice(["", "at"]), ""),
            (0, f"20{text(2, string.digits)}-0{draw.randint(1, 9)}-{draw.randint(10, 28)}T"
             f"{draw.randint(10, 23)}", "", False, draw.choice(["", "on"]), ""),
            (0, f"20{text(2, string.digits)}-0{draw.randint(1, 9)}-{draw.randint(10, 28)}T"
             f"{draw.randint(10, 23)}:{draw.randint(10, 59)}:{draw.randint(10, 59)}Z", "", False,
             draw.choice(["", "on"]), ""),
        ]
    return rows


class Language:
    """The words of all texts: letter transitions and a dictionary."""

    def __init__(self, pairs: np.ndarray, words: Iterable[str]) -> None:
        counts = pairs + 1.0
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))
        self.words = frozenset(words) | {w for w in DICTIONARY if len(w) >= 3}
        self.longest = max(map(len, self.words))

    @staticmethod
    def codes(word: str) -> np.ndarray:
        """Letters a to z as 0 to 25, all else 26."""
        raw = np.frombuffer(word.lower().encode("latin-1", "replace"), np.uint8).astype(np.int64) - 97
        return np.where((raw >= 0) & (raw < 26), raw, 26)

    def likely(self, value: str) -> float:
        codes = self.codes(value)
        return float(self.log[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def covered(self, value: str) -> float:
        """Share of the characters in dictionary words, longest first from the left."""
        low, at, hit = value.lower(), 0, 0
        while at < len(low):
            size = next((n for n in range(min(self.longest, len(low) - at), 2, -1)
                         if low[at:at + n] in self.words), 0)
            hit += size
            at += size or 1
        return hit / len(low)


def features(language: Language, value: str, key: str, quoted: bool, before: str,
             after: str) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o"
             for c in value]
    kind = Counter(kinds)
    counts = Counter(value)
    run = max(len(m) for m in re.findall(r"[^\W\d_]+|.", value, re.DOTALL))
    key, near = key.lower(), before.lower()
    return [float(x) for x in (
        n, kind["d"] / n, kind["u"] / n, kind["l"] / n, kind["o"] / n, len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, run / n,
        all(c in string.hexdigits for c in value), language.likely(value), language.covered(value),
        _NUMBER.fullmatch(value) is not None, _ADDRESS.search(value) is not None,
        _UUID.fullmatch(value) is not None, value.count("/"), value.count("."),
        "://" in value or value.startswith("www."), quoted, bool(key),
        _KEYWORD.search(key) is not None, _KEYWORD.search(near) is not None,
        _HARMLESS.search(f"{key} {near}") is not None,
        format_of(value) != "pem" and _HARMLESS.search(value.lower()) is not None,
        after[:1].islower(), format_of(value) is not None)]


class Forest:
    """Trees as arrays, so that any task can apply them."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], language: Language) -> None:
        self.trees, self.language = trees, language

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, limit, left, right, share in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                inner = left[node] >= 0
                low = rows[np.arange(len(rows)), feature[node]] <= limit[node]
                node = np.where(inner, np.where(low, left[node], right[node]), node)
            total += share[node]
        return total / len(self.trees)

    def judge(self, found: list[tuple]) -> np.ndarray:
        """Probability that each finding is a secret."""
        if not found:
            return np.empty(0)
        return self.probabilities(np.array(
            [features(self.language, *f[1:]) for f in found]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id"] + [c.split()[0] for c in FINDING.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
    for batch in batches:
        rows = [(doc, *f) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"])
                for f in findings(text.as_py())]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def detect(docs: DataFrame, work: Callable = iter,
           schema: str = f"doc_id bigint, {FINDING}") -> DataFrame:
    """All findings, before any is judged, or what ``work`` makes of their batches in the same pass."""
    ready = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return ready.mapInArrow(lambda batches: work(_find(batches)), schema)


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = [known_label(*row) for row in zip(
            *(batch[c].to_pylist() for c in ("value", "key", "before", "after")))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.int32()), *batch.columns], ["label", *batch.schema.names])


def labelled(docs: DataFrame) -> DataFrame:
    """Findings with a label that is certain by format and key."""
    return detect(docs, _label, f"label int, doc_id bigint, {FINDING}").where("label IS NOT NULL")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task how often each letter follows each other, from words and their counts."""
    total = np.zeros((27, 27))
    for batch in batches:
        for word, times in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
            codes = Language.codes(word)
            np.add.at(total, (codes[:-1], codes[1:]), times)
    a, b = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])], ["a", "b", "n"])


def language(docs: DataFrame) -> Language:
    """Letter pairs and dictionary of all words of letters in all texts, but those in capitals."""
    plain = r"^\\p{L}+$"
    counts = docs.select(F.explode(F.split(whole_text(), r"\s+")).alias("word")).where(
        f"word rlike '{plain}' AND word <> upper(word)").groupBy(F.lower("word").alias("word")).agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= WORD_TIMES)
    counts = stored(counts, "secret-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = np.zeros((27, 27))
    for r in counts.mapInArrow(_pairs, "a int, b int, n double").groupBy("a", "b").agg(
            F.sum("n").alias("n")).collect():
        pairs[r["a"], r["b"]] = r["n"]
    words = counts.where((F.length("word") >= 4) & (F.col("n") * 1_000_000 >= WORD_SHARE * total)) \
        .select("word").collect()  # at most 1,000,000 / WORD_SHARE
    released(counts)
    return Language(pairs, [r["word"] for r in words])


def train(labels: DataFrame, known: Language, per_label: int = PER_LABEL) -> Forest:
    """A forest from labelled findings (label, value, key, quoted, before, after)."""
    spark = labels.sparkSession
    columns = ["label", "value", "key", "quoted", "before", "after"]
    order = [F.xxhash64(*columns[1:]), *columns[1:]]
    first = Window.partitionBy("label").orderBy(*order)
    sample = labels.select(*columns).distinct().withColumn("_rank", F.row_number().over(first)) \
        .where(F.col("_rank") <= per_label).drop("_rank").collect()
    rows = [(int(r[0]), features(known, *r[1:])) for r in [*sample, *made_up()]]
    return Forest(_fitted(spark, rows), known)


def learned(docs: DataFrame) -> Forest:
    """A forest from the findings of the documents that are certain, and their words."""
    return train(labelled(docs), language(docs))


def _fitted(spark: SparkSession, rows: list[tuple[int, list[float]]]) -> list[tuple]:
    table = spark.createDataFrame(rows, "label int, row array<double>").select(
        F.col("label").cast("double"), array_to_vector("row").alias("features")).coalesce(2)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False,
                                    featureSubsetStrategy="sqrt").fit(table)
    path = shared_folder(spark, "secret-forest")
    forest.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees = []
    for number in range(TREES):  # at most 2 ** (DEPTH + 1) nodes each
        own = sorted((n for n in nodes if n["treeID"] == number), key=lambda n: n["id"])
        place = {n["id"]: i for i, n in enumerate(own)}
        trees.append((
            np.array([max(0, n["split"]["featureIndex"]) for n in own], np.int64),
            np.array([(n["split"]["leftCategoriesOrThreshold"] or [0.0])[0] for n in own]),
            np.array([place.get(n["leftChild"], -1) for n in own], np.int64),
            np.array([place.get(n["rightChild"], -1) for n in own], np.int64),
            np.array([n["impurityStats"][1] / sum(n["impurityStats"]) for n in own])))
    return trees


def _judged(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in
                              ("start", "value", "key", "quoted", "before", "after"))))
            scores = forest.judge(rows)
            kinds = [format_of(r[1]) or ("assigned" if r[2] else "bare") for r in rows]
            digest = [hashlib.sha256(r[1].encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], pa.array([len(r[1]) for r in rows], pa.int32()),
                 pa.array(kinds, pa.string()), pa.array(digest, pa.string()),
                 pa.array(scores, pa.float64())],
                ["doc_id", "start", "length", "kind", "value_sha256", "score"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """All findings of the documents with their score and verdict; values only as digests."""
    forest = learned(docs)
    return detect(docs, _judged(forest), "doc_id bigint, start int, length int, kind string, "
                  "value_sha256 string, score double").withColumn("is_secret", F.col("score") >= 0.5)


def redacted(text: str, forest: Forest) -> str:
    """Of secrets inside one another the outermost is masked, but of a URL only what is inside."""
    found = findings(text)
    spans = [(f[0], f[0] + len(f[1]), "://" in f[1] and format_of(f[1]) is None)
             for f, score in zip(found, forest.judge(found)) if score >= 0.5]
    parts, done = [], 0
    for k, (begin, end, url) in enumerate(spans):
        if begin < done or url and k + 1 < len(spans) and spans[k + 1][0] < end:
            continue
        parts += [text[done:begin], MASK]
        done = end
    return "".join([*parts, text[done:]]) if parts else text


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each secret replaced by a mask; ``n_chars`` follows where present.

    Only the texts go to Python, and only changed ones come back.
    """
    forest = learned(docs)

    @F.arrow_udf("string")
    def masked(text: pa.Array) -> pa.Array:
        changed = []
        for t in text.to_pylist():
            clean = redacted(t, forest) if t else t
            changed.append(None if clean == t else clean)
        return pa.array(changed, pa.string())

    clean = docs.withColumn("text", F.coalesce(masked(F.col("text").cast("string")), "text"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(
            F.col("n_chars").isNotNull() & F.col("text").isNotNull(),
            F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean
