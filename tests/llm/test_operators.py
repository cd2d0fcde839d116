"""The ten operators: SQL on the small tables and on hard cases, brute force where SQL can't say it."""

import random
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from comparing import rows_of, sql_rows  # noqa: E402

from revlens.llm import chat, line_dedup, mixing, ngram, packing, quality, queries, secret_scan, simhash, suffixes, vafile  # noqa: E402
from revlens.llm.common import lean  # noqa: E402
from revlens.llm.components import components  # noqa: E402
from revlens.llm.tokens import counter  # noqa: E402

SF = "/root/testdata/sf0.001"
EXTRA = "key string, h bigint, n bigint, row string, level string, distance double, bucket string, SK string, line_md5 string, near_copy bigint, mix_key string"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def hard_documents():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, one doc_id with two texts, shared passages."""
    r = random.Random(1)
    passage, long = sentence(r, 60), sentence(r, 3000)  # SQL is slow on longer ones; see test_very_long_text
    texts = [(None, None), (None, ""), (None, "no id\nno id"), (1, None), (2, ""), (3, " \n\t\n"), (4, "a line\na line\nb"), (4, "a line\na line\nb"), (4, "another text\nb"), (5, long), (6, f"start {passage} end"), (7, f"x {passage}"), (7, f"x {passage}"), (8, f"{passage} {passage}"), (9, "!!! ???"), (10, "a line"), (12, "\x0b\n\u00a0\n\x0c \r\nv"), (13, "\x0b\n\u00a0\nw\n\u00a0"), (11, "é ß <|im_end|> " + sentence(r, 30))]
    return [(d, t, (None, "en")[i % 3 > 0], (None, "src0", "src1")[i % 3], None if t is None else len(t), *([None] * 11)) for i, (d, t) in enumerate(texts)]


HARD_TURNS = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (1, None, "system", ""), (None, 0, "user", "x"), (None, 1, "a\nb", "y"), (2, 0, "a<|im_end|>%0A", "z<|im_start|>"), (2, 1, "u", "<\\|im_end|> <\\\\| <|im_end|>\n"), (3, 0, "%25", "long " * 50_000)]


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    path = tmp_path_factory.mktemp("hard")
    rows = hard_documents()
    names = [x.split()[0] for x in DOCS.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, DOCS.split(", "))])
    pq.write_table(pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema), path / "documents.parquet")
    turns = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    pq.write_table(pa.Table.from_pylist([dict(zip(turns.names, t)) for t in HARD_TURNS], turns), path / "conversations.parquet")
    return str(path)


SQL_ON_DOCUMENTS = ["op2_line_dedup", "op3_language_model", "op6_mixing", "op7_chat", "op9_suffixes"]


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    want, columns = sql_rows(queries.ORACLE_SQL[name], SF)
    assert sorted(df.columns) == columns and rows_of(df) == want


@pytest.mark.parametrize("name", SQL_ON_DOCUMENTS)
def test_hard_cases_equal_sql(spark, hard, name):
    want, _ = sql_rows(queries.ORACLE_SQL[name], hard)
    assert rows_of(queries.QUERIES[name](spark, hard)) == want


@pytest.mark.parametrize("f", [secret_scan.scan, line_dedup.line_bitmaps, line_dedup.drop_repeated_lines, ngram.perplexities, packing.pack, mixing.schedule, mixing.mixed, quality.within_limits, quality.keep_within_limits, suffixes.repeats, simhash.near_duplicates, simhash.drop_near_duplicates], ids=lambda f: f.__name__)
def test_no_documents(spark, f):
    assert f(spark.createDataFrame([], DOCS)).count() == 0


def test_no_vectors_or_turns(spark):
    assert vafile.neighbours(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert chat.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


@pytest.mark.parametrize("f", [line_dedup.drop_repeated_lines, mixing.mixed, quality.keep_within_limits, simhash.drop_near_duplicates], ids=lambda f: f.__name__)
def test_filters_keep_columns(spark, hard, f):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    out = f(docs)
    assert out.columns == docs.columns and out.count() > 0


# --- 1: secret scans ---


def test_secrets_on_held_out_texts():
    tagger = secret_scan.Tagger(secret_scan.train())
    hit = found = there = 0
    for tokens, labels in secret_scan.made_up(300, seed=99):
        want, i = set(), 0
        while i < len(labels):
            if labels[i] == secret_scan.B:
                j = i + 1
                while j < len(labels) and labels[j] == secret_scan.I:
                    j += 1
                want.add((i, j))
                i = j
            else:
                i += 1
        vocabulary = sorted(set(tokens))
        got = {(a, b) for _, a, b, _ in tagger.tag(vocabulary, np.array([vocabulary.index(t) for t in tokens]), np.array([0, len(tokens)]))}
        hit, found, there = hit + len(got & want), found + len(got), there + len(want)
    assert hit / found > 0.95 and hit / there > 0.95


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(3)
    for _ in range(20):
        n = int(r.integers(1, 6))
        e, t = r.normal(size=(n, 3)), r.normal(size=(4, 4))

        def total(y):
            return t[3, y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)) + t[y[-1], 3]

        every = [np.unravel_index(k, (3,) * n) for k in range(3**n)]
        assert np.isclose(total(secret_scan.viterbi(e, t, 3, 3)), max(map(total, every)))


def test_secrets_in_hard_cases(spark):
    secret = "0123456789abcdef0123456789abcdef01234567"
    text = f'some words here and then token = "{secret}" and more words'
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "plain words only " * 20_000)], "doc_id bigint, text string")
    got = secret_scan.scan(rows).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"]
    assert {text[r["start"] : r["end"]] for r in got} == {secret}


# --- 2: line dedup ---


def test_bitmaps_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 50):
        kept = np.flatnonzero(r.random(n) < 0.5)
        assert np.flatnonzero(line_dedup.bits(line_dedup.runs(kept, n))).tolist() == kept.tolist()


def test_kept_lines(spark, hard):
    out = {(r["doc_id"], r["text"]): r["n_chars"] for r in line_dedup.drop_repeated_lines(spark.read.parquet(f"{hard}/documents.parquet")).collect()}
    assert (4, "a line\nb") in out or (4, "another text\nb") in out
    assert not [k for k in out if k[0] == 10] and (2, "") in out and (1, None) in out
    assert all(n == len(t) for (_, t), n in out.items() if t)


def test_kept_lines_equal_brute_force(spark, hard):
    """Also on a text of 30,000 lines, and on one with as many words in a line."""
    r = random.Random(22)
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{hard}/documents.parquet").collect()]
    rows += [(100, "\n".join(sentence(r, 2) for _ in range(30_000)) + "\na line"), (101, sentence(r, 30_000)), (102, "own\n" + rows[3][1] if rows[3][1] else "own\na line")]
    import hashlib

    def order(x):
        return (x[0] is not None, x[0] or 0, x[1] is not None and hashlib.md5(x[1].encode()).hexdigest() or "")

    seen, want = set(), []
    for d, t in sorted(set(rows), key=order):
        lines = [] if t is None else t.split("\n")
        kept = []
        for x in lines:
            if not x.strip(" \t\r\f\v") or x not in seen:
                kept.append(x)
            seen.add(x)
        if len(kept) == len(lines) or "".join(kept).strip(" \t\r\f\v"):
            want.append((d, None if t is None else "\n".join(kept)))
    got = [(x["doc_id"], x["text"]) for x in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- 3: language model ---


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, sentence(random.Random(i % 7), 30)) for i in range(20)], "doc_id bigint, text string")
    model = ngram.fit(docs)
    vocabulary = sorted({w for r in docs.collect() for w in r["text"].split()})
    every = ngram._hashes(vocabulary)
    right = np.append(every[:-2], every[-1])  # all words and the end, not the beginning
    for left in every[[0, 5, -2]]:
        total = np.exp(model.logs(np.full(len(right), left), right)).sum() + np.exp(model.logs(np.array([left]), ngram._hashes(["unseen word"])[:1]))[0]
        assert abs(total - 1) < 1e-9


def kneser_ney(texts, order):
    """Log probabilities of the texts under the interpolated modified Kneser-Ney model of them, from dictionaries."""
    from collections import Counter, defaultdict

    lists = [["<s>", *t.split(), "</s>"] for t in texts]
    raw = {k: Counter(tuple(w[i : i + k]) for w in lists for i in range(len(w) - k + 1)) for k in range(1, order + 1)}
    count = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in raw[k + 1])
        if k > 1:
            count[k].update({g: c for g, c in raw[k].items() if g[0] == "<s>"})
    discount = {k: (0.0, *ngram.discounts(*(sum(c == i for c in x.values()) for i in (1, 2, 3, 4)))) for k, x in count.items()}
    of = {k: defaultdict(list) for k in count}
    for k, x in count.items():
        for g, c in x.items():
            of[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / (len(count[1]) + 1)
        k, there = len(g), of[len(g)].get(g[:-1])
        if not there:
            return p(g[1:])
        d, c = discount[k], count[k][g]
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in there) * p(g[1:])) / sum(there)

    return [sum(np.log(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(1, len(w))) for w in lists]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_each_order_equals_brute_force(spark, order):
    r = random.Random(order)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randint(1, 40))) for _ in range(60)] + ["a", "a b c d e " * 300]
    got = {x["doc_id"]: x["log_probability"] for x in ngram.perplexities(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), order).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], kneser_ney(texts, order), atol=1e-3)


def test_unseen_words_leave_what_shorter_contexts_say(spark):
    """Sums to one after contexts with one continuation, with many, and unseen ones."""
    docs = spark.createDataFrame([(i, sentence(random.Random(i % 9), 12)) for i in range(18)], "doc_id bigint, text string")
    model = ngram.fit(docs, 3)
    vocabulary = sorted({w for r in docs.collect() for w in r["text"].split()})
    every = ngram._hashes(vocabulary)
    right, first = np.append(every[:-2], every[-1]), docs.first()["text"].split()
    at = {w: h for w, h in zip(vocabulary, every)}
    for a, b in ((at[first[0]], at[first[1]]), (every[-2], at[first[0]]), (at[first[5]], at[first[1]]), (ngram._hashes(["unseen"])[0], at[first[1]]), (at[first[1]], ngram._hashes(["unseen"])[0])):
        sides = [np.full(len(right), x) for x in (a, b)]
        total = np.exp(model.logs(*sides, right)).sum() + np.exp(model.logs(np.array([a]), np.array([b]), ngram._hashes(["other unseen"])[:1]))[0]
        assert abs(total - 1) < 1e-9


def test_production_tells_stitched_pairs_from_phrases(spark):
    """All of a text's pairs are common, but not in a row; a model of bigrams can't see it."""
    texts = ["x a b", "y b c", "z c d", "x a b q", "y b c q", "z c d q"] * 20 + ["a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    two, more = ({x["doc_id"]: x["perplexity"] for x in f.collect()} for f in (ngram.perplexities(docs, 2), ngram.perplexities(docs)))
    assert more[120] > two[120] and more[0] < two[0]


# --- 4: exact top-k ---


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(300, 8)), 1).astype(np.float32)
    x[50:60] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, [1.0] * 8), (900, None), (901, []), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0, 2.0]), (905, [1.0, 2.0])]
    got = {}
    for row in vafile.neighbours(spark.createDataFrame([(*v, "x") for v in rows], "vec_id bigint, embedding array<float>, distance string"), every=1).collect():
        got.setdefault(row["vec_id"], {})[row["rank"]] = (row["neighbour_id"], row["distance"])
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2))
    for i in range(300):
        order = [int(j) for j in np.lexsort((np.arange(300), d[i])) if j != i][:10]
        assert [got[i][k + 1][0] for k in range(10)] == order
    assert got[904] == {1: (905, 0.0)} and not {None, 900, 901, 902, 903} & got.keys()


@pytest.mark.parametrize("large", [1e20, 3e38, 1e-42])
def test_neighbours_beside_outliers(spark, large):
    """Squares that single precision can't hold, too large or too small, lose nothing."""
    r = np.random.default_rng(20)
    x = r.normal(size=(32, 4)).astype(np.float32) * np.float32(min(large, 1))
    x[30], x[31] = large, -np.float32(large)
    got = {}
    for row in vafile.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"), every=1).collect():
        got.setdefault(row["vec_id"], {})[row["rank"]] = row["neighbour_id"]
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2))
    for i in range(32):
        order = [int(j) for j in np.lexsort((np.arange(32), d[i])) if j != i][:10]
        assert [got[i][k + 1] for k in range(10)] == order


def test_queries_are_ids_divisible_by_fifty(spark):
    rows = [(i, [float(i)]) for i in range(120)]
    got = vafile.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=1).collect()
    assert {(r["vec_id"], r["neighbour_id"]) for r in got} == {(0, 1), (50, 49), (100, 99)}


# --- 5: packing ---


def test_least_squares_is_optimal():
    r = np.random.default_rng(5)
    for _ in range(10):
        a, b = r.random((6, 12)), r.normal(size=6)
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-6).all() and np.abs(gradient[x > 1e-9]).max(initial=0) < 1e-6


def test_plan_places_every_piece():
    r = np.random.default_rng(6)
    for units in (4, 16):
        histogram = r.integers(0, 50, units)
        plan = packing.plan(histogram)
        assert (sum(k * shape for shape, k in plan) == histogram).all()
        assert all((shape * np.arange(1, units + 1)).sum() <= units for shape, _ in plan)


def test_packing(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    got = packing.pack(docs).collect()
    count = counter(packing.TOKENIZER)
    want, have, full = {}, {}, {}
    for r in docs.collect():
        if n := int(count(pa.array([r["text"]], pa.string()))[0]):
            want.setdefault(r["doc_id"], []).append(n + 1)
    for r in got:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["n_tokens"]
        full[r["bin"]] = full.get(r["bin"], 0) + r["n_tokens"]
    assert have == {k: sum(v) for k, v in want.items()}
    assert max(full.values()) <= packing.WINDOW and len({(r["bin"], r["slot"]) for r in got}) == len(got)


def test_token_counts_equal_whole_texts():
    import base64

    import tiktoken

    from revlens.llm.tokens import PATTERN

    with open(packing.TOKENIZER, "rb") as f:
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    texts = ["", " a", "a b", "a  b", "a\nb c", "don't  \n x", "été ß 12,5 %%", " x y", "a \n b", None, "x" * 500 + " y"]
    assert counter(packing.TOKENIZER)(pa.array(texts)).tolist() == [len(encoding.encode_ordinary(t or "")) for t in texts]


# --- 6: mixing ---


def test_weights_must_be_positive(spark):
    with pytest.raises(ValueError):
        mixing.schedule(spark.createDataFrame([], DOCS), weights={"a": 0.0})


def test_mixed_is_what_is_scheduled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r["doc_id"] for r in mixing.mixed(docs).collect()) == sorted(r["doc_id"] for r in mixing.schedule(docs).collect())


# --- 7: chat ---


def test_chat_round_trip():
    r = random.Random(4)
    parts = ["<|im_start|>", "<|im_end|>", "<\\|", "<|", "\\", "\n", "%25", "%0A", "%3C", "<", "a"]
    for _ in range(500):
        turns = [("".join(r.choices(parts, k=r.randint(0, 4))), "".join(r.choices(parts, k=r.randint(0, 6)))) for _ in range(r.randint(0, 3))]
        assert chat.parse(chat.format_turns(turns)[0]) == turns
    with pytest.raises(chat.Malformed):
        chat.parse("<|im_start|>user\nhi")


# --- 8: quality rules ---


def test_outliers_go_and_the_rest_stays(spark):
    r = random.Random(8)
    good = [(i, sentence(r, 80).capitalize() + ".", ("en", "de")[i % 2], "s") for i in range(600)]
    bad = [(1000 + i, sentence(r, 80).upper().replace(" ", "!! "), "en", "s") for i in range(20)]
    other = [(2000, None, "en", "s"), (2001, "", None, None), (2002, " ", "en", None), (None, sentence(r, 80).capitalize() + ".", "en", "s"), (5, good[5][1], "de", "s")]
    kept = [x["doc_id"] for x in quality.within_limits(spark.createDataFrame(good + bad + other, "doc_id bigint, text string, lang string, source string")).collect()]
    assert sum(k is not None and k < 600 for k in kept) == 601 and not [k for k in kept if k is not None and k >= 1000]
    assert None in kept


def least_determinant(x, floor, support, tries=200):
    """Mean and determinant of the best subset of a share of x that concentration steps from many random ones lead to."""
    r = np.random.default_rng(0)
    h, found = int(np.ceil(support * len(x))), (np.inf, None)
    for _ in range(tries):
        own = x[r.choice(len(x), 6, replace=False)]
        for _ in range(60):
            mu, cov = own.mean(axis=0), np.cov(own.T, bias=True) + np.diag(floor)
            d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            own = x[np.argsort(d, kind="stable")[:h]]
        found = min(found, (np.linalg.det(np.cov(own.T, bias=True) + np.diag(floor)), own.mean(axis=0).tolist()))
    return found


def test_estimates_equal_brute_force(spark):
    """Beside a fifth of outliers on one side, which medians and deviations are drawn to, and in a group without any."""
    r = np.random.default_rng(21)
    mixing_ = r.normal(size=(4, 4))
    a = r.normal(size=(400, 4)) @ mixing_
    a[:80] = r.normal(size=(80, 4)) * 0.3 + [6, -5, 4, 9]
    b = r.normal(size=(150, 4)) @ r.normal(size=(4, 4)) + 3
    c = np.array([[1.0, 2.0, 3.0, 4.0]])
    floor = [1e-3] * 4
    rows = spark.createDataFrame([(k, *map(float, v)) for k, x in (("a", a), ("b", b), ("c", c)) for v in x], "key string, x0 double, x1 double, x2 double, x3 double")
    got = {e["key"]: e for e in quality.best(rows, floor).collect()}
    for k, x in (("a", a), ("b", b)):
        det, mu = least_determinant(x, floor, quality.SUPPORT)
        assert 0.95 * det < got[k]["det"] < 1.03 * det
        assert np.allclose(got[k]["mu"], mu, atol=0.1 if k == "a" else 0.3)  # many subsets of b are nearly as good
    assert np.allclose(got["c"]["mu"], c[0]) and got["c"]["n"] == 1


def test_judged_as_by_the_estimates(spark, monkeypatch):
    """Distances follow from the estimates of fit(), whether these are broadcast or salted; a group of one is judged by its pool."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.expr("if(doc_id = 7, 'own', lang)").alias("lang"), "source")
    table, rates = quality.statistics(docs)
    fitted = {e["level"]: e for e in quality.fit(table, rates).collect()}
    rows = table.where("w > 0").select("row.doc_id", quality.keys()[0].alias("level"), *quality.vector(*map(F.lit, rates))).collect()
    got = {r["doc_id"]: r["distance"] for r in quality.within_limits(docs, distance=1e9).collect()}
    assert len(rows) == len(got)
    for r in rows:
        e = fitted[r["level"]]
        z = np.array([r[x] for x in quality.X]) - np.array(e["mu"])
        assert np.isclose(np.sqrt(z @ np.array(e["inverse"]).reshape(4, 4) @ z / e["scale"]), got[r["doc_id"]])
    assert 0 < got[7] < 20
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    salted = {r["doc_id"]: r["distance"] for r in quality.within_limits(docs, distance=1e9).collect()}
    assert salted.keys() == got.keys() and all(np.isclose(salted[k], got[k]) for k in got)


# --- 9: suffix-array dedup ---


def test_interleaving_equals_sorting():
    r = np.random.default_rng(9)
    texts = [r.integers(10, 13, 20) for _ in range(6)]
    shards, arrays, base = [], [], 0
    for group in (texts[:2], texts[2:4], texts[4:]):
        symbols = np.concatenate([np.append(t, base + i) for i, t in enumerate(group)])
        ends = np.cumsum([len(t) + 1 for t in group]) - 1
        sa, bwt = suffixes.transform(symbols, ends)
        arrays.append([tuple(symbols[a : ends[np.searchsorted(ends, a)] + 1]) for a in sa])
        shards.append(bwt)
        base += len(group)
    order, lcp = suffixes.interleave(shards, 25)
    taken, merged = [iter(a) for a in arrays], []
    for s in order:
        merged.append(next(taken[s]))
    assert merged == sorted(merged)
    for a, b, n in zip(merged, merged[1:], lcp[1:]):
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == min(common, 25)


def test_more_shards_than_two_bytes_count():
    n = (1 << 16) + 3
    order, lcp = suffixes.interleave([np.array([n - i, i]) for i in range(n)], 1)
    assert len(order) == 2 * n and order.max() == n - 1 and np.bincount(order).tolist() == [2] * n


# --- 10: near copies ---


def near_copies(docs):
    """All pairs of documents compared by their words themselves: pairs, and the smallest doc_id of each group, by text.

    Nothing of the operator is used but its limits: signatures are majorities over the words' bits, sets are Python's.
    """
    import xxhash

    def spread(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m % (1 << 64)
        return x ^ x >> 33

    sets, signatures, ids = [], [], []
    for d, t in docs:
        own = {w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„«»¿¡") for w in t.split()} - {""}
        if own:
            hashes = [xxhash.xxh3_64_intdigest(w) for w in own]
            bits = np.array([[x >> (63 - i) & 1 for y in (x, spread(x ^ 0x9E3779B97F4A7C15)) for x in [y] for i in range(64)] for x in hashes])
            sets.append(own)
            signatures.append(2 * bits.sum(axis=0) > len(own))
            ids.append(d)
    signatures = np.array(signatures)
    label, pairs = list(range(len(ids))), []

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in (np.flatnonzero((signatures[i] != signatures[i + 1 :]).sum(axis=1) <= simhash.RADIUS) + i + 1).tolist():
            common = len(sets[i] & sets[j])
            if common >= simhash.SHARE * (len(sets[i]) + len(sets[j]) - common):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
                pairs.append((ids[i], ids[j]))
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, d in enumerate(ids)}, pairs


@pytest.fixture(scope="module")
def all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    return docs, *near_copies(docs)


def test_near_copies_against_all_pairs(spark, all_pairs):
    docs, truth, pairs = all_pairs
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    joined = sum(a in got and got[a] == got.get(b) for a, b in pairs)
    assert len(pairs) > 50 and joined >= 0.95 * len(pairs)
    assert all(truth[d] == truth[g] for d, g in got.items())  # nothing that all pairs leave apart


def test_no_recall_below_the_asked_is_returned(spark, all_pairs, monkeypatch):
    """A search that finds nothing, however often it is repeated, ends with all pairs."""
    docs, truth, pairs = all_pairs
    monkeypatch.setattr(simhash, "candidates", lambda nodes, radius, orders: spark.createDataFrame([], simhash.EDGES))
    monkeypatch.setattr(simhash, "MOST_ORDERS", simhash.ORDERS)
    monkeypatch.setattr(simhash, "BLOCK", 300)
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(got.get(a) == truth[a] == got.get(b) for a, b in pairs)


def test_shards_find_each_others_copies(spark, all_pairs, monkeypatch):
    docs, _, pairs = all_pairs
    monkeypatch.setattr(simhash, "SHARD", 200)
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert sum(a in got and got[a] == got.get(b) for a, b in pairs) >= 0.95 * len(pairs)


def test_groups_larger_than_the_widest_beam(spark, monkeypatch):
    """300 near copies of one text and 300 of another, and few that link to either: groups stay whole and apart."""
    monkeypatch.setattr(simhash, "WIDEST", 16)
    r = random.Random(15)
    words = [[sentence(r, 1) for _ in range(100)] for _ in range(2)]
    docs = []
    for k in range(600):
        own = list(words[k % 2])
        own[r.randrange(100)] = f"own{k}"
        docs.append((k, " ".join(own)))
    got = {x["doc_id"]: x["group_id"] for x in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {k: k % 2 for k in range(600)}


def test_graph_search_recall():
    r = np.random.default_rng(10)
    h = r.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    for i in range(1000):
        h[2000 + i] = h[i]
        for b in r.choice(128, 14, replace=False).tolist():
            h[2000 + i, b // 64] ^= np.uint64(1 << b % 64)
    ids = np.arange(3000)
    a, b, nr = np.concatenate(simhash._linked(h, ids, h, ids, simhash.RADIUS, simhash.ORDERS), axis=1)
    edges = set(zip(a.tolist(), b.tolist()))
    assert sum((i, 2000 + i) in edges for i in range(1000)) >= 950


def test_simhash_hard_cases(spark):
    r = random.Random(11)
    text = sentence(r, 120)
    rows = [(5, text), (3, text.upper() + "."), (5, text), (None, text), (7, None), (8, ""), (9, "?!"), (10, sentence(r, 120)), (11, sentence(r, 30_000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r["doc_id"], r["group_id"]) for r in simhash.near_duplicates(docs).collect()} == {(3, 3), (5, 3)}
    left = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(left, key=repr) == sorted([x for x in rows if x[0] not in (5, None)], key=repr)


def test_one_id_with_several_texts(spark):
    """What goes is a text, not an id: a text of its own stays, and copies of it are found."""
    r = random.Random(16)
    a, c, d = (sentence(r, 120) for _ in range(3))
    rows = [(3, a), (4, a + " x"), (4, c), (5, d), (6, c + " q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(x["doc_id"], x["group_id"]) for x in simhash.near_duplicates(docs).collect()} == {(3, 3), (4, 3), (4, 4), (6, 4)}
    assert {(x["doc_id"], x["text"]) for x in simhash.drop_near_duplicates(docs).collect()} == {(3, a), (4, c), (5, d)}


def test_audit_sees_small_groups_beside_a_large_one(spark):
    """A large group that is joined whole doesn't hide pairs that are all missed."""
    r = np.random.default_rng(14)
    base = r.integers(0, 1 << 63, (41, 2), dtype=np.uint64)
    flip = np.stack((np.uint64(1) << r.integers(0, 63, 300, dtype=np.uint64), np.zeros(300, np.uint64)), axis=1)
    h = np.concatenate((base[0] ^ flip, base[1:], base[1:] ^ np.uint64(1))).view(np.int64)
    group = np.concatenate((np.zeros(300, int), np.arange(1, 41), np.arange(1, 41)))
    nodes = spark.createDataFrame([(i, int(x), int(y), np.array([k], np.uint32).tobytes()) for i, ((x, y), k) in enumerate(zip(h, group))], "id bigint, h1 bigint, h2 bigint, words binary")
    large = [(i, 0) for i in range(300)]
    small = [(i, 300 + (i - 300) % 40) for i in range(300, 380)]
    got = [simhash.audit(nodes, nodes, spark.createDataFrame(x, "node bigint, component bigint"), simhash.RADIUS, simhash.SHARE) for x in (large, small, large + small)]
    assert got == [0.0, 0.0, 1.0]


def test_components(spark):
    r = random.Random(12)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    joined = {x for a, b in edges if a != b for x in (a, b)}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in label.items() if k in joined}


def test_very_long_text(spark):
    r = random.Random(13)
    passage, a, b = sentence(r, 70), sentence(r, 100_000), sentence(r, 50)
    docs = spark.createDataFrame([(1, f"{a} {passage} {b}"), (2, f"q {passage}")], "doc_id bigint, text string")
    got = {x["doc_id"]: (x["start"], x["end"]) for x in suffixes.repeats(docs).collect()}
    assert got == {1: (100_000, 100_070), 2: (1, 71)}
    assert {x["doc_id"]: x["n_words"] for x in ngram.perplexities(docs).collect()} == {1: 100_120, 2: 71}


def test_simhash_sums_are_bounded():
    """The lanes of all words at once took 128 bytes for each word of a slice."""
    n, r = 400_000, np.random.default_rng(1)
    hashes, word = r.integers(0, 1 << 63, 1000).astype(np.uint64), r.integers(0, 1000, n)
    for starts in (np.arange(0, n, 100), np.array([0, 1, 70_000, *range(200_000, n, 100)])):  # also more words than are summed at once
        ends = np.append(starts[1:], n)
        tracemalloc.start()
        got = simhash._simhashes(hashes, word, starts, ends)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20e6
        for i in (0, 1, 2, 3, len(starts) - 1):
            bits = np.unpackbits(hashes[word[starts[i] : ends[i]]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            assert int(got[i]) == int("".join("01"[int(x)] for x in 2 * bits.sum(axis=0, dtype=int) > len(bits)), 2)


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_workers_give_memory_back():
    """Between tasks a worker holds no more than before; what is freed below a small block in use stayed before."""
    pins = []

    def work(batches):
        held = [np.ones(8000) for _ in range(3000)]
        pins.append(np.ones(8000))
        yield from batches
        held.clear()

    before = resident()
    assert len(list(lean(work)(iter([1, 2])))) == 2
    assert resident() - before < 40e6


def test_language_model_keeps_one_level_on_disk(spark, monkeypatch):
    """The shuffle files and blocks of a level are gone when the next one is merged, and all of them at the end."""
    docs = spark.createDataFrame([(i, f"a b c w{i % 7} d") for i in range(40)], "doc_id bigint, text string")
    tracker, live, tables = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker(), [], []
    release, write = ngram.shuffles_released, ngram.written

    def released(s):
        full = tracker.shuffleStatuses().size()
        release(s)
        live.append((full, tracker.shuffleStatuses().size()))

    monkeypatch.setattr(ngram, "shuffles_released", released)
    monkeypatch.setattr(ngram, "written", lambda df, tag: tables.append(write(df, tag)) or tables[-1])
    release(spark)
    before = tracker.shuffleStatuses().size()
    ngram.fit(docs, 3)
    assert [full > after for full, after in live] == [True, True] and live[-1][1] <= before
    assert len(tables) == 2 and not any(Path(ngram.local_path(t.written_to)).exists() for t in tables)
