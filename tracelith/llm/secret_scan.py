"""Secret scans: candidate strings judged by a random forest.

Candidates are strings of known credential formats (private keys with their header lines), values
assigned to a credential's name, bare or in quotes, and long runs of key characters that mix letters
with digits. A forest of decision trees, grown in numpy from labelled findings, tells secrets from
the rest by the candidate's length and character transitions, how much of it dictionary words cover,
its path, and the words before and after it.

The dictionary is the corpus's own: the DICTIONARY commonest words (letters alone, four or more, whole)
of all texts that are held to be scanned, counted over all of them. Findings are (candidate, path,
label). Without given findings, FINDINGS of them are made by a seeded rule out of public credential
formats and dictionary words; given ones are used whole, and bounded by their caller. Every text is
scanned whole. Null and empty texts have no candidates. Repeated rows are treated alike. Columns
besides doc_id, text and source play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelith.llm.arrays import RangeHash, ragged
from tracelith.llm.run import mapped, slices, small_batches, text_of

FINDINGS, TREES, DEPTH, LEAST_LEAF, SEED = 4000, 40, 12, 3, 10
BEFORE, AFTER = 48, 32
#: So many of the commonest words, of LONGEST letters at most, each found LEAST_TIMES: the dictionary's size, and what is broadcast, is bounded by it.
DICTIONARY, SHORTEST, LONGEST, LEAST_TIMES = 20_000, 4, 16, 5

# Fixed formats: public credential formats of well-known services, and PEM private keys.
KNOWN = {
    "aws": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b",
    "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,250}",
    "stripe": r"\b[sr]k_live_[A-Za-z0-9]{16,250}",
    "google": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:\s*\n[A-Za-z][A-Za-z0-9-]{0,60}:[^\n]*(?:\n[ \t]+[^\s][^\n]*)*+)*+[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?",
}
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private_key", "bearer")
HARMLESS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "revision", "uuid", "guid", "id", "integrity", "etag", "version", "url", "http", "https", "image", "file", "path", "isbn", "order", "phone", "card", "call")
PLACEHOLDERS = ("example", "sample", "dummy", "test", "fake", "placeholder", "change", "your", "here", "insert", "default", "xxxx", "abcd", "1234", "0000")
TEST_PATHS = ("test", "spec", "example", "sample", "fixture", "mock", "doc", "readme")

CANDIDATE = re.compile("|".join([*(f"(?P<{k}>{v})" for k, v in KNOWN.items()), r"(?P<assigned>(?ai:\b[\w-]*(?:" + "|".join(NAMES) + r")[\w-]{0,30}[\"']?\]?\s{0,3}[:=]{1,2}>?\s{0,3})[\"']?(?P<value>[^\s\"'<>;,]{6,}))", r"(?P<run>[A-Za-z0-9_+/=-]{20,})"]))
RUN = re.compile(r"(?P<run>[A-Za-z0-9_+/=-]{20,})(?P<value>\\Z\\A)?")
#: A text without any of these, in lower case, can hold no candidate but a run.
HINTS = ("passw", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "k_live_", "aiza", "eyj", "-----begin ")
SPLIT = re.compile(r"[^A-Za-z0-9_]+")


@dataclass
class Finding:
    start: int
    stop: int
    text: str
    before: str
    kind: str
    after: str = ""


def candidates(text: str) -> list[Finding]:
    out = []
    low = text.lower()
    for m in (CANDIDATE if any(h in low for h in HINTS) else RUN).finditer(text):
        kind = "assigned" if m["value"] else next(k for k in (*KNOWN, "run") if m[k]) if m.re is CANDIDATE else "run"
        group = "value" if kind == "assigned" else kind
        start, stop = m.span(group)
        found = m[group].rstrip(".")
        if kind == "run" and not (any(c.isdigit() for c in found) and any(c.isalpha() for c in found)):
            continue
        out.append(Finding(start, start + len(found), found, text[max(0, start - BEFORE) : start], kind, text[start + len(found) : start + len(found) + AFTER]))
    return out


#: Lower and upper case, digits, the rest.
KIND_OF = {c: "a" if chr(c).islower() else "A" if chr(c).isupper() else "0" if chr(c).isdigit() else "-" for c in range(0x250)}
LETTERS = re.compile(r"[a-z]{4,}")


def covered(low: str, words: frozenset[str]) -> float:
    """The share of characters that dictionary words cover, the longest word at each place."""
    out = 0
    for m in LETTERS.finditer(low):
        run, at, end = m[0], 0, 0
        for at in range(len(run) - SHORTEST + 1):
            n = next((n for n in range(min(LONGEST, len(run) - at), SHORTEST - 1, -1) if run[at : at + n] in words), 0)
            if at + n > end:
                out += at + n - max(at, end)
                end = at + n
    return out / max(1, len(low))


def features(f: Finding, path: str, words: frozenset[str] = frozenset()) -> list[float]:
    s, low = f.text, f.text.lower()
    n = len(s)
    kinds = s.translate(KIND_OF)
    moves = Counter(zip(kinds, kinds[1:], strict=False))
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    ahead, behind = ([w.lower() for w in SPLIT.split(x) if w] for x in (f.before, f.after))
    ahead, behind = ahead[-4:], behind[:4]
    tail = " ".join(ahead)
    steps = max(1, n - 1)
    return [
        min(n, 400), entropy, entropy / max(1.0, math.log2(min(n, 64))), len(counts) / n, *(kinds.count(k) / n for k in "aA0-"),
        sum(v for (a, b), v in moves.items() if a != b) / steps, moves["a", "0"] / steps, moves["0", "a"] / steps, moves["a", "A"] / steps, moves["A", "a"] / steps, moves["0", "0"] / steps, moves["a", "a"] / steps,
        max((len(r) for r in re.findall(r"[a-z]+", s)), default=0), covered(low, words), sum(a == b for a, b in zip(s, s[1:], strict=False)) / steps, sum(ord(b) - ord(a) == 1 for a, b in zip(s, s[1:], strict=False)) / steps,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", s))), float(n in (32, 40, 64)), s.count("/") / n, s.count("_") + s.count("-"),
        float(any(w in tail for w in NAMES)), float(any(w in HARMLESS for w in ahead)), float(bool(re.search(r"[:=]>?\s*[\"']?$", f.before))), float(f.before[-1:] in ("'", '"')), float(f.before[-1:] in ("/", ".", "@")),
        float(any(w in HARMLESS for w in behind)), float(any(w in NAMES for w in behind)), float(f.after[:1] in ("'", '"')), float(f.after[:1] in ("/", "(", ".", "=")),
        float(f.kind in KNOWN), float(f.kind == "assigned"), float(f.kind == "pem"), float(any(p in path.lower() for p in TEST_PATHS)), float("${" in s or "<" in s or "(" in s), float(any(p in low for p in PLACEHOLDERS)),
    ]


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> frozenset[str]:
    """The commonest words of all texts: counted in batches, then over all; `most` of them come to the driver."""
    letter = np.zeros(256, bool)
    letter[ord("a") : ord("z") + 1] = True
    # part of a word, but no letter of the dictionary: digits, marks of keys, and all beyond ASCII
    other = np.zeros(256, bool)
    other[[ord(c) for c in "0123456789_+/=-"]] = other[128:] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, _, _ = ragged(t.lower() + b" " for t in batch.column("text").to_pylist())
            inside = letter[raw]
            edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
            start, stop = edge[::2], edge[1::2]
            joined = other[raw]
            n = stop - start
            ok = (n >= SHORTEST) & (n <= LONGEST) & ~joined[np.maximum(start - 1, 0)] & ~joined[np.minimum(stop, len(raw) - 1)] if len(n) else n > 0
            start, n = start[ok], n[ok]
            _, first, times = np.unique(RangeHash(raw, 31)(start, n), return_index=True, return_counts=True)
            spelled = [raw[a : a + k].tobytes().decode() for a, k in zip(start[first].tolist(), n[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.string()), pa.array(times, pa.int64())], ["word", "times"])

    found = docs.select(text_of(docs).alias("text")).mapInArrow(run, "word string, times long").groupBy("word").agg(F.sum("times").alias("times")).filter(F.col("times") >= LEAST_TIMES)
    return frozenset(r.word for r in found.orderBy(F.desc("times"), "word").limit(most).select("word").collect())


def labelled(n: int = FINDINGS, seed: int = SEED, words: frozenset[str] = frozenset()) -> list[tuple[Finding, str, int]]:
    """Labelled findings by a seeded rule: half are credentials where such stand, half are what scans mistake for them."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes, every = "0123456789abcdef", lower + upper + digits
    paths = ["src/app.py", "config/prod.env", "src7", "web", "lib/net.go", "tests/test_login.py", "docs/readme.md", "examples/a.py"]
    prose = ["is of the", "que la de", "and then", "zu der", "siehe", ""]
    syllables = ["tion", "er", "the", "ing", "and", "ment", "able", "ver", "con", "ad", "que"]
    known = sorted(words)
    word = lambda: r.choice(known) if known and r.random() < 0.7 else "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    formats = {
        "aws": lambda: r.choice(["AKIA", "ASIA"]) + pick(upper + digits, 16), "github": lambda: "gh" + r.choice("pousr") + "_" + pick(every, 36), "stripe": lambda: r.choice("sr") + "k_live_" + pick(every, r.choice([24, 40, 99])),
        "slack": lambda: "xox" + r.choice("abprs") + "-" + "-".join(pick(digits, r.randrange(9, 14)) for _ in range(r.randrange(1, 4))) + "-" + pick(r.choice([every, hexes]), r.choice([24, 32])),
        "google": lambda: "AIza" + pick(every + "-_", 35), "jwt": lambda: "eyJ" + pick(every, r.randrange(15, 60)) + ".eyJ" + pick(every, r.randrange(20, 200)) + "." + pick(every + "-_", 43),
    }
    out = []
    while len(out) < n:
        secret = len(out) % 2
        path, kind, lead = r.choice(paths), "run", r.choice(prose) + " "
        if secret:
            which = r.randrange(9)
            if which == 0:
                kind = r.choice(sorted(formats))
                s = formats[kind]()
                lead = r.choice([lead, lead + r.choice(NAMES) + "=", lead + '"', "export KEY=", "https://x.org/?key=", ""])
            elif which == 1:
                kind, s = "pem", "-----BEGIN RSA PRIVATE KEY-----\n" + r.choice(["", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{pick('0123456789ABCDEF', 32)}\n\n"]) + pick(every + "+/", r.randrange(60, 900)) + "\n-----END RSA PRIVATE KEY-----"
            elif which == 2:
                human = pick(upper, 1) + pick(lower, r.randrange(2, 7)) + pick(digits, r.randrange(1, 4)) + r.choice("-_!@#$%&*.") + pick(lower + digits, r.randrange(2, 6))
                kind, s = "assigned", r.choice([human, pick(every + "!@#$%^&*", r.randrange(8, 24))])
            elif which >= 7:
                # no separator follows a name: bare keys, those beside a credential's name, and hexadecimal ones only beside a name
                named = r.random() < 0.5
                alphabet, k = r.choice([(every, r.randrange(20, 64)), (every + "+/", r.choice([32, 40, 44, 64])), (every + "-_", r.randrange(24, 64)), (upper + digits, 32), *[(hexes, 32), (hexes, 64)] * named])
                s = pick(alphabet, k)
                if named:
                    name = r.choice(["", "my_", "db_", "client_"]) + r.choice(NAMES)
                    lead += r.choice([f'"{name}", "', f"('{name}', '", f'"{name}" "', f"--{name} ", f"{name} ", f'"{name}": ["', f'"{name}": {{"value": "'])
                else:
                    lead = r.choice([lead, lead + '"', "", "use ", "key "])
            else:
                alphabet, k = r.choice([(hexes, 32), (hexes, 40), (hexes, 64), (every, r.randrange(20, 50)), (every + "+/", 40), (upper + digits, 32)])
                kind, s = "assigned", pick(alphabet, k)
            if kind == "assigned":
                name = r.choice(NAMES)
                lead += r.choice(["", "my_", "db_", "client_"]) + r.choice([name, name.upper()]) + r.choice([" = ", "=", ": ", ":", " := ", '": ', '":', "': ", '"] = ', '" => ']) + r.choice(["", '"', "'"])
                path = r.choice(paths[:5]) if r.random() < 0.9 else path
        else:
            which = r.randrange(11)
            if which == 0:
                s, lead = pick(hexes, r.choice([32, 40, 64])), lead + r.choice(HARMLESS[:9]) + r.choice([" ", ": ", "=", ' = "'])
            elif which == 1:
                s = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
                lead += r.choice(["id ", "uuid: ", 'guid="', "request "])
            elif which == 2:
                kind, s = "assigned", r.choice(["your_token_here", "changeme", "example-password", "${API_TOKEN}", "os.environ[x]", "test1234", "xxxxxxxxxxxxxxxx", "<password>", "get_secret()", "placeholder123", "dummy_token_value", word() + word(), "password123", "None", "string"])
                lead += r.choice(NAMES) + r.choice([" = ", "=", ": ", '": ', "': "]) + r.choice(["", '"'])
            elif which == 3:
                s = "_".join(word() for _ in range(r.randrange(3, 6))) + pick(digits, r.randrange(1, 4))
            elif which == 4:
                s = "/".join(word() for _ in range(r.randrange(3, 7))) + "/v" + pick(digits, 2)
                lead += r.choice(["path ", "https://", "file "])
            elif which == 5:
                s = base64.b64encode(" ".join(word() for _ in range(r.randrange(3, 60))).encode()).decode() + pick(digits, 1)
                lead += r.choice(["image data:", "integrity sha512-", "content "])
            elif which == 6:
                s = word() + word().title() + word().title() + word().title() + pick(digits, r.randrange(1, 3))
            elif which == 7:
                kind, s = "assigned", " ".join([word() + r.choice(["", ".", pick(digits, 2)])])
                s = s if len(s) >= 6 else s + "ation"
                s = r.choice([s, s.title()])
                lead += r.choice([r.choice(NAMES) + ": ", r.choice(["author", "authors", "tokenizer", "secretary"]) + r.choice([": ", '": "', "': '"])])
            elif which == 8:
                s = pick(every + "+/", r.choice([43, 64, 86])) + "="
                lead += r.choice(["integrity sha512-", "integrity sha256-", "checksum ", "etag ", "digest: ", "image "])
            elif which == 9:
                # known formats as documentation spells them
                kind = r.choice(sorted(formats))
                s = formats[kind]()
                mark = r.choice(["EXAMPLE", "EXAMPLEKEY", "XXXXXXXX", "0000000000"])
                s = s[:4] + "X" * (len(s) - 4) if r.random() < 0.3 else s[: len(s) - len(mark)] + mark
            else:
                s = r.choice([pick("ab-=+_", 30) + "1", "a1" * r.randrange(10, 40), "=" * 20 + "v2" + "=" * 20, pick(digits, 25) + "x", "2024-01-01T00-00-00-000Z" + pick(digits, 3), pick(hexes, 40)])
                if len(set(s)) > 8:
                    lead = r.choice(prose) + " "
        close = lead[-1:] if lead[-1:] in ("'", '"') else ""
        after = close + r.choice(["", "\n", " " + word() + " " + word(), ", ", ";\n", ") " + word(), ". " + word().title()])
        out.append((Finding(0, len(s), s, lead, kind, after), path, secret))
    return out


class Forest:
    """Random forest of binary trees on bootstrapped rows, each node split on the best of a random few features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = r.integers(0, len(x), len(x))
            self.trees.append(tuple(map(np.array, zip(*self.grow(x[rows], y[rows], depth, r), strict=True))))

    @staticmethod
    def grow(x: np.ndarray, y: np.ndarray, depth: int, r: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
        """Nodes (feature or -1, threshold, left, right, share of secrets)."""
        nodes: list = [None]
        todo = [(0, np.arange(len(x)), depth)]
        while todo:
            at, rows, left = todo.pop()
            share, best = float(y[rows].mean()), None
            if left and len(rows) >= 2 * LEAST_LEAF and 0 < share < 1:
                for j in r.permutation(x.shape[1])[: int(math.sqrt(x.shape[1])) + 1]:
                    values = x[rows, j]
                    order = np.argsort(values, kind="stable")
                    v, ones = values[order], np.cumsum(y[rows][order])
                    k = np.arange(1, len(rows))
                    ok = (v[1:] > v[:-1]) & (k >= LEAST_LEAF) & (len(rows) - k >= LEAST_LEAF)
                    if ok.any():
                        a, b = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(rows) - k)
                        gini = np.where(ok, k * a * (1 - a) + (len(rows) - k) * b * (1 - b), np.inf)
                        i = int(np.argmin(gini))
                        if best is None or gini[i] < best[0]:
                            middle = float((v[i] + v[i + 1]) / 2)
                            best = (gini[i], int(j), middle if middle < v[i + 1] else float(v[i]))
            if best is None:
                nodes[at] = (-1, 0.0, at, at, share)
                continue
            goes = x[rows, best[1]] <= best[2]
            nodes[at] = (best[1], best[2], len(nodes), len(nodes) + 1, share)
            todo += [(len(nodes), rows[goes], left - 1), (len(nodes) + 1, rows[~goes], left - 1)]
            nodes += [None, None]
        return nodes

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (feature[at] >= 0).any():
                go = np.where(feature[at] >= 0, x[np.arange(len(x)), feature[at]] <= threshold[at], True)
                at = np.where(go, left[at], right[at])
            total += share[at]
        return total / len(self.trees)


def train(findings: list[tuple[Finding, str, int]], words: frozenset[str] = frozenset()) -> Forest:
    return Forest(np.array([features(f, p, words) for f, p, _ in findings]), np.array([y for _, _, y in findings], float))


@dataclass
class Model:
    words: frozenset[str]
    forest: Forest


def fitted(docs: DataFrame, findings: list[tuple[Finding, str, int]] | None = None) -> Model:
    words = dictionary(docs)
    return Model(words, train(findings if findings is not None else labelled(words=words), words))


def judged(model: Model, texts: list[str], paths: list[str]) -> list[list[tuple[Finding, float]]]:
    """Each text's candidates with the share of trees' votes that they are secrets."""
    found = [candidates(t) for t in texts]
    flat = [(f, p) for x, p in zip(found, paths, strict=True) for f in x]
    votes = iter(model.forest.predict(np.array([features(f, p, model.words) for f, p in flat])).tolist()) if flat else iter(())
    return [[(f, next(votes)) for f in x] for x in found]


def secrets_of(found: list[tuple[Finding, float]]) -> list[Finding]:
    return [f for f, vote in found if vote >= 0.5]


def without(text: str, secrets: list[Finding]) -> str:
    parts, at = [], 0
    for f in secrets:
        parts += [text[at : f.start], "[SECRET]"]
        at = f.stop
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, findings: list[tuple[Finding, str, int]] | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start:end of the secrets, in code points), redacted_sha256 and, if asked for, redacted: the text with [SECRET] for each."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, findings))
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), path.alias("path"))
    schema = "doc_id long, n_candidates long, n_secrets long, spans string, redacted_sha256 string" + ", redacted string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            ids, texts, paths = (c.to_pylist() for c in batch.columns)
            out = []
            for doc_id, text, found in zip(ids, texts, judged(model, texts, paths), strict=True):
                secrets = secrets_of(found)
                redacted = without(text, secrets)
                out.append((doc_id, len(found), len(secrets), ",".join(f"{f.start}:{f.stop}" for f in secrets), hashlib.sha256(redacted.encode()).hexdigest(), redacted))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()][: 5 + with_text]
            names = ["doc_id", "n_candidates", "n_secrets", "spans", "redacted_sha256", "redacted"][: 5 + with_text]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, [SECRET] standing for each secret in `text`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            paths = batch.column("source").to_pylist() if "source" in batch.schema.names else [""] * len(texts)
            found = judged(shared.value, [t or "" for t in texts], [str(p or "") for p in paths])
            clean = [t if t is None else without(t, secrets_of(x)) for t, x in zip(texts, found, strict=True)]
            yield batch.set_column(at, "text", pa.array(clean, pa.string()))

    return mapped(docs, run)
