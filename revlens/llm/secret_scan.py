"""Secret scans by a linear-chain conditional random field."""

from __future__ import annotations

import functools
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, words

O, B, I = 0, 1, 2  # noqa: E741
#: Made-up texts that the model is trained on; steps and rate of the optimiser; its squared-weight penalty.
TEXTS, STEPS, RATE, PENALTY = 1200, 90, 0.15, 2e-6
WORD = re.compile(r"[^ \t\n\r\f\x0b]+")
EDGES = "\"'`*&%$#!?,;.:()[]{}<>|"
ASSIGNED = re.compile(r"^[\"']?[A-Za-z_][A-Za-z0-9_.\-]*[\"']?[=:][\"']?(?=.)")
HEX, DIGITS, BASE64 = (re.compile(p) for p in ("[0-9a-fA-F]+", r"[0-9][0-9.\-/+]*", r"[A-Za-z0-9+/_\-]+={0,2}"))
UUID = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
CREDENTIAL = re.compile(r"[a-z0-9+]+://[^/\s:@]+:[^/\s@]+@")


def core(token: str) -> tuple[int, int]:
    """Where in a token its value is: without punctuation around it, and without a name that it is assigned to."""
    a = len(token) - len(token.lstrip(EDGES))
    b = len(token.rstrip(EDGES))
    if a >= b:
        return 0, len(token)
    m = ASSIGNED.match(token[a:b])
    if m and not token[a + m.end() :].startswith("//"):
        a += m.end()
    return a, b


def shape(token: str) -> list[str]:
    """Features of a token's form."""
    bare = token.strip(EDGES)
    if bare.isalpha():
        return ["alpha", "caps" if bare.isupper() else "title" if bare[0].isupper() else "lower", f"n{min(len(bare), 30).bit_length()}"]
    a, b = core(token)
    value = token[a:b]
    kinds = [k for k, p in (("hex", HEX), ("digits", DIGITS), ("base64", BASE64), ("uuid", UUID)) if p.fullmatch(value)]
    n = len(value)
    frequency = Counter(value).values()
    entropy = -sum(c / n * math.log2(c / n) for c in frequency) if n else 0.0
    digits, upper, lower = (sum(map(f, value)) for f in (str.isdigit, str.isupper, str.islower))
    mixed = (digits > 0) + (upper > 0) + (lower > 0)
    out = ["kind:" + "+".join(kinds), f"len:{min(n // 8, 8)}", f"entropy:{min(int(entropy), 5)}", f"mixed:{mixed}", f"kind:{'+'.join(kinds)}/len:{min(n // 8, 8)}", f"start:{value[:4]}"]
    out += ["email"] * ("@" in value and "://" not in value) + ["url"] * ("://" in value) + ["credential"] * bool(CREDENTIAL.search(value)) + ["dashes"] * token.startswith("-----")
    if a and ASSIGNED.match(token.lstrip(EDGES)):
        out += ["assigned", "name:" + re.split("[=:]", token.lstrip(EDGES))[0].strip("\"'").lower()[-12:]]
    if n >= 8 and entropy >= 3 and mixed >= 2:
        out.append("dense")
    return out


def near(token: str) -> str:
    """What a neighbour sees of a token: the word in lower case, or the kind of its form."""
    bare = token.strip(EDGES).lower()
    if not bare:
        return "mark:" + token[:3]
    return bare if len(bare) <= 24 and not any(c.isdigit() for c in bare) else "number" if bare.isdigit() else "long"


#: Parts of a token's score: its form, the neighbours at -2, -1 and 1, and the file.
PARTS = ("shape", "near-2", "near-1", "near1", "file")


def file_features(marked: float, code: float) -> list[str]:
    """Of a text: shares of its tokens with other characters than letters, and of marks of assignment."""
    return [f"marked:{min(int(marked * 5), 4)}", f"code:{min(int(code * 40), 4)}"]


# --- made-up training texts ---


def _value(r: random.Random) -> list[str]:
    """A made-up secret, as tokens."""
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    alnum, base = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    kind = r.randrange(10)
    if kind <= 2:
        return [pick("0123456789abcdef", r.choice((32, 40, 40, 64)))]
    if kind == 3:
        return ["AKIA" + pick(string.ascii_uppercase + string.digits, 16)]
    if kind == 4:
        return [r.choice(("ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-")) + pick(alnum, r.randint(20, 40))]
    if kind == 5:
        return [f"eyJhbGciOi{pick(alnum, 20)}.eyJ{pick(alnum, 40)}.{pick(alnum + '_-', 43)}"]
    if kind == 6:
        return [pick(base, r.choice((40, 44, 64))) + r.choice(("", "=", "=="))]
    if kind == 7:
        return [pick(alnum + "!@#^*", r.randint(10, 20))]
    return [pick(alnum, r.randint(16, 48))]


def _secret(r: random.Random) -> tuple[list[str], list[int]]:
    """A secret with what stands around it: tokens and labels."""
    value = _value(r)
    name = r.choice(("token", "token", "api_key", "apikey", "secret", "password", "passwd", "pwd", "key", "client_secret", "access_token", "auth_token", "private_key", "AWS_SECRET_ACCESS_KEY", "DB_PASSWORD", "SECRET_KEY"))
    quote = r.choice(('"', '"', "'", ""))
    form = r.randrange(9)
    if form <= 2:
        return [name, r.choice(("=", "=", ":", ":=")), quote + value[0] + quote], [O, O, B]
    if form == 3:
        return [f"{name}={quote}{value[0]}{quote}"], [B]
    if form == 4:
        return [name + ":", quote + value[0] + quote], [O, B]
    if form == 5:
        return ["Authorization:", r.choice(("Bearer", "Basic", "Token")), value[0]], [O, O, B]
    if form == 6:
        return [f"{r.choice(('postgres', 'mysql', 'https', 'amqp'))}://{r.choice(('admin', 'root', 'app'))}:{value[0][:16].replace('/', 'x').replace('@', 'x')}@db.example.com/main"], [B]
    if form == 7:
        lines = ["".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(r.randint(2, 5))]
        what = r.choice(("RSA", "EC", "OPENSSH"))
        return ["-----BEGIN", what, "PRIVATE", "KEY-----", *lines, "-----END", what, "PRIVATE", "KEY-----"], [B] + [I] * (7 + len(lines))
    return ["--" + name, value[0]] if r.random() < 0.5 else ["export", f"{name.upper()}={value[0]}"], [O, B]


def _harmless(r: random.Random) -> list[str]:
    """Tokens that look like secrets and are none."""
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexes, digits = "0123456789abcdef", string.digits
    uuid = "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12))
    return r.choice([
        ["commit", pick(hexes, 40)], ["sha256:", pick(hexes, 64)], ["md5", "=", pick(hexes, 32)], ["checksum", pick(hexes, 40)], ["revision", pick(hexes, r.choice((7, 12, 40)))], ["id", "=", uuid], ["id:", f'"{uuid}"'], [uuid],
        [f"{pick(string.ascii_lowercase, 5)}.{pick(digits, 2)}@mail.example.com"], [f"https://{pick(string.ascii_lowercase, 6)}.example.com/{pick(string.ascii_lowercase + digits, 9)}"], [f"({pick(digits, 3)})", f"555-{pick(digits, 4)}"],
        [pick(digits, 16)], [".".join(pick("123456789", 2) for _ in range(4))], ["count", "=", pick(digits, r.randint(1, 5))], ["name", "=", f'"{pick(string.ascii_lowercase, 8)}"'], ["version:", f"{pick('123', 1)}.{pick(digits, 1)}.{pick(digits, 1)}"],
        ["color", "=", "#" + pick(hexes, 6)], ["the", "token", "is"], ["a", "secret", "key"], ["password", "policy"], ["[" + pick(digits, 2) + "]"], ["$" + pick(digits, 3) + ".00"], [pick(digits, 4) + "-" + pick(digits, 2) + "-" + pick(digits, 2)], ["data:image/png;base64," + pick(string.ascii_letters + digits, 60)],
    ])


def made_up(n: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Texts as tokens and labels."""
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti", "st", "ar", "te", "se", "ing", "ion", "que", "ment", "ción", "éré", "ung", "sch", "ß", "ü", "á"]
    out = []
    for _ in range(n):
        tokens: list[str] = []
        labels: list[int] = []
        noisy, loud = r.random() < 0.15, r.random() < 0.08
        code = r.random() < 0.2
        for _ in range(r.randint(1, 5)):
            for _ in range(r.randint(1, 14)):
                w = "".join(r.choice(parts) for _ in range(r.randint(1, 5)))
                w = w.upper() + "!!" if loud else w.capitalize() + r.choice(("", ",")) if r.random() < 0.15 else w + r.choice((".", ",", ":")) if r.random() < 0.12 else w
                tokens.append(r.choice(("if", "=", "return", "{", "}", "def", "x", "(a,", "b)", "==", "+", "1", "|")) if code and r.random() < 0.5 else w)
                labels.append(O)
            if r.random() < 0.45:
                t, y = _secret(r)
            else:
                t = _harmless(r)
                y = [O] * len(t)
            tokens += t
            labels += y
        if noisy:
            tokens = [t + r.choice(("***", "&&&", "%%%", "$$$", "###")) if r.random() < 0.9 else t for t in tokens]
        out.append((tokens, labels))
    return out


@dataclass
class Model:
    weights: dict[str, dict[str, list[float]]]
    transitions: list[list[float]]  # of O, B, I and the text's ends


def _sequence(tokens: list[str]) -> list[list[tuple[str, str]]]:
    marked = sum(not t.strip(EDGES).isalpha() for t in tokens) / max(1, len(tokens))
    code = sum(t in ("=", ":=", "{", "}", "==", ":") for t in tokens) / max(1, len(tokens))
    seen = ["<s>", "<s>", *map(near, tokens), "</s>"]
    out = []
    for i, t in enumerate(tokens):
        f = [("shape", x) for x in shape(t)] + [("near-2", seen[i]), ("near-1", seen[i + 1]), ("near1", seen[i + 3])]
        out.append(f + [("file", x) for x in file_features(marked, code)])
    return out


@functools.cache
def train(texts: int = TEXTS, seed: int = 7) -> Model:
    """Maximum likelihood on made-up texts, by gradients of all sequences at once (forward and backward sums)."""
    data = made_up(texts, seed)
    ids: dict[tuple[str, str], int] = {}
    counts: Counter = Counter()
    rows = [_sequence(t) for t, _ in data]
    for seq in rows:
        for f in seq:
            counts.update(f)
    for k, c in counts.items():
        if c >= 5:
            ids[k] = len(ids)
    n, length, width = len(data), max(len(t) for t, _ in data), max(len(f) for s in rows for f in s)
    pad = len(ids)
    feats = np.full((n, length, width), pad, np.int32)
    gold, sizes = np.zeros((n, length), np.int64), np.array([len(t) for t, _ in data])
    for i, (seq, (_, y)) in enumerate(zip(rows, data)):
        gold[i, : len(y)] = y
        for j, f in enumerate(seq):
            got = [ids[k] for k in f if k in ids]
            feats[i, j, : len(got)] = got
    mask = np.arange(length)[None, :] < sizes[:, None]
    w, t = np.zeros((pad + 1, 3)), np.zeros((4, 4))
    gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    at = np.arange(n)
    flat, where = feats[mask], np.nonzero(mask)
    true_w = np.stack([np.bincount(flat.ravel(), np.repeat(gold[mask] == y, width), pad + 1) for y in range(3)], axis=1)
    true_t = np.zeros((4, 4))
    np.add.at(true_t, (3, gold[:, 0]), 1)
    np.add.at(true_t, (gold[at, sizes - 1], 3), 1)
    inner = mask[:, 1:]
    np.add.at(true_t, (gold[:, :-1][inner], gold[:, 1:][inner]), 1)
    for _ in range(STEPS):
        e = np.zeros((n, length, 3))
        e[mask] = w[flat].sum(axis=1)
        alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        alpha[:, 0] = e[:, 0] + t[3, :3]
        for j in range(1, length):
            x = np.logaddexp.reduce(alpha[:, j - 1, :, None] + t[None, :3, :3], axis=1) + e[:, j]
            alpha[:, j] = np.where(mask[:, j, None], x, alpha[:, j - 1])
        z = np.logaddexp.reduce(alpha[:, -1] + t[:3, 3], axis=1)
        beta[:, -1] = t[:3, 3]
        for j in range(length - 2, -1, -1):
            x = np.logaddexp.reduce(t[None, :3, :3] + (e[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
            beta[:, j] = np.where(mask[:, j + 1, None], x, t[:3, 3])
        p = np.exp(alpha + beta - z[:, None, None])
        g = true_w - np.stack([np.bincount(flat.ravel(), np.repeat(p[where][:, y], width), pad + 1) for y in range(3)], axis=1)
        pair = np.exp(alpha[:, :-1, :, None] + t[None, None, :3, :3] + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        gtr = true_t.copy()
        gtr[:3, :3] -= pair[inner].sum(axis=0)
        gtr[3, :3] -= p[:, 0].sum(axis=0)
        gtr[:3, 3] -= p[at, sizes - 1].sum(axis=0)
        g = g / n - PENALTY * n * w
        gtr = gtr / n - PENALTY * n * t
        g[pad] = 0
        gw += g * g
        gt += gtr * gtr
        w += RATE * g / np.sqrt(gw)
        t += RATE * gtr / np.sqrt(gt)
    weights: dict[str, dict[str, list[float]]] = {p: {} for p in PARTS}
    for (part, f), k in ids.items():
        weights[part][f] = (w[k] - w[k, O]).tolist()
    return Model(weights, t.tolist())


def viterbi(e: np.ndarray, t: np.ndarray, before: int, after: int) -> list[int]:
    """The best labels of tokens with scores e, between the labels (3: the text's end) before and after; ties to O."""
    score, back = t[before, :3] + e[0], []
    for x in e[1:]:
        both = score[:, None] + t[:3, :3]
        back.append(both.argmax(axis=0))
        score = both.max(axis=0) + x
    y = [int((score + t[:3, after]).argmax())]
    for b in reversed(back):
        y.append(int(b[y[-1]]))
    return y[::-1]


def _margins(t: np.ndarray) -> np.ndarray:
    """By how much O must lead B and I in a token's score, so that O is right whatever stands before and after."""
    gain = t[:, :3, None] + t[None, :3, :]  # before, label, after
    return (gain - gain[:, :1, :]).max(axis=(0, 2))


class Tagger:
    def __init__(self, model: Model):
        self.weights = {p: {k: np.array(v, np.float64) for k, v in w.items()} for p, w in model.weights.items()}
        self.t = np.array(model.transitions)
        self.margins = _margins(self.t)
        self.known: dict[str, tuple] = {}

    def scores(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its own score and its scores as a neighbour, each by label; whether it is marked, and code."""
        zero = np.zeros(3)
        own, two, one, after = (np.zeros((len(vocabulary) + 1, 3)) for _ in range(4))
        marked, code = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
        w_shape, w2, w1, w3 = (self.weights[p] for p in PARTS[:4])
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for i, token in enumerate(vocabulary):
            got = known.get(token)
            if got is None:
                s = zero
                for f in shape(token):
                    x = w_shape.get(f)
                    if x is not None:
                        s = s + x
                k = near(token)
                got = known[token] = (s, w2.get(k, zero), w1.get(k, zero), w3.get(k, zero), not token.strip(EDGES).isalpha(), token in ("=", ":=", "{", "}", "==", ":"))
            own[i], two[i], one[i], after[i], marked[i], code[i] = got
        return own, two, one, after, marked, code

    def tag(self, vocabulary: list[str], codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, first token, end token, score) of each secret in texts of coded tokens.

        The best labelling under the model: tokens whose score puts O beyond what any neighbours could change are O, and
        Viterbi's algorithm decides the runs between them. An I that follows O begins a secret as B does.
        """
        n = len(codes)
        if not n:
            return []
        own, two, one, after, marked, code = self.scores(vocabulary)
        last = len(vocabulary)
        sizes = np.diff(offsets)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        starts, ends = offsets[:-1][sizes > 0], offsets[1:][sizes > 0] - 1
        head, tail = self.weights["near-1"].get("<s>", np.zeros(3)), self.weights["near1"].get("</s>", np.zeros(3))
        head2 = self.weights["near-2"].get("<s>", np.zeros(3))
        two[last], one[last], after[last] = head2, head, tail
        prev = np.concatenate(([last], codes[:-1]))
        prev[starts] = last
        prev2 = np.concatenate(([last], prev[:-1]))
        prev2[starts] = last
        follow = np.concatenate((codes[1:], [last]))
        follow[ends] = last
        file = np.zeros((len(sizes), 3))
        sums = [np.add.reduceat(x[codes], starts) / sizes[sizes > 0] for x in (marked, code)]
        for i, (m, c) in zip(np.flatnonzero(sizes > 0), zip(*sums)):
            for f in file_features(m, c):
                x = self.weights["file"].get(f)
                if x is not None:
                    file[i] += x
        e = own[codes]
        e += two[prev2]
        e += one[prev]
        e += after[follow]
        e += file[doc]
        open_ = np.flatnonzero((e[:, 0, None] - e[:, 1:] < self.margins[1:]).any(axis=1))
        if not len(open_):
            return []
        cut = np.flatnonzero((np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]])) + 1
        found = []
        for run in np.split(open_, cut):
            a, b = int(run[0]), int(run[-1]) + 1
            d = int(doc[a])
            y = viterbi(e[a:b], self.t, 3 if a == offsets[d] else O, 3 if b == offsets[d + 1] else O)
            i = 0
            while i < len(y):
                if y[i] != O:
                    j = i + 1
                    while j < len(y) and y[j] == I:
                        j += 1
                    at = np.arange(a + i, a + j)
                    found.append((d, a + i - int(offsets[d]), a + j - int(offsets[d]), float(sum(e[k, y[k - a]] - e[k, O] for k in at))))
                    i = j
                else:
                    i += 1
        return found


def scan(docs: DataFrame, texts: int = TEXTS, seed: int = 7) -> DataFrame:
    """(doc_id, start, end, n_tokens, score): where in a document's text (characters from 0, end exclusive) secrets are.

    Tokens are what ASCII white space separates. A secret is a token tagged B and those tagged I that follow it; start and
    end leave out quotes and punctuation around it, and a name that it is assigned to. score: by how much the tags' token
    scores lead those of O. The model is trained on made-up texts, the same for any table.

    Null and empty texts have no secrets. Repeated rows, and rows without doc_id, are scanned like others. An empty table
    gives an empty result. Other columns are not read.
    """
    model = train(texts, seed)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in sliced(batches, "text"):
            vocabulary, codes, offsets = words(batch.column("text"))
            rows = []
            spans: dict[int, list[tuple[int, int]]] = {}
            for d, a, b, score in tagger.tag(vocabulary, codes, offsets):
                text = batch.column("text")[d].as_py()
                if d not in spans:
                    spans = {d: [m.span() for m in WORD.finditer(text)]}
                first, final = spans[d][a], spans[d][b - 1]
                x, y = core(text[slice(*first)]) if b - a == 1 else (0, final[1] - final[0])
                rows.append((d, first[0] + x, final[0] + y, b - a, score))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *(pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.float64())))], names=["doc_id", "start", "end", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tag, "doc_id bigint, start bigint, end bigint, n_tokens int, score double")
