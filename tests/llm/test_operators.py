"""Each query against SQL or brute force, and the hard cases: nulls, empty and long texts, repeats, empty tables, clashing names."""

import base64
import hashlib
import re
import zlib
from functools import cache
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
import xxhash
from oracle import comparable, sql_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from campusquery.llm import chat, mixing, neardup, packing, pii, quality, sharding, topk, toxicity, warc
from campusquery.llm.common import Work
from campusquery.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, n string"
PROSE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, PROSE, "en", "a", 1), (3, PROSE, "en", "a", 1), (4, PROSE, "en", "b", 1), (None, PROSE + " x", "en", "b", 1),
    (5, "one two", None, None, 7), (6, "ONE two", "en", "b", 7), (7, "word " * 40000, "de", "a", 9), (8, PROSE + " tail", "en", "c", 3), (9, "\n \t\n", "en", "c", 3), (10, "é" * 5000, "fr", "a", 3),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with hard documents, and one whose tables are all empty."""
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("odd", "empty"))
    tables = {
        "documents": spark.createDataFrame([(*r, 1, "x", "y") for r in ROWS], DOCS),
        "labels": spark.createDataFrame([(1, 0, 0), (3, 1, 1), (3, 1, None), (4, None, 0), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, "http://a\r\n/ü %", "<p>same</p>", 1), (2, None, "<p>same</p>", 1), (3, "u", None, 1), (4, "u", "WARC/1.1\r\n\r\nx\r\n\r\n", 1), (4, "u", "WARC/1.1\r\n\r\nx\r\n\r\n", 1), (None, "u", "", 1)], "page_id long, url string, html string, first int"),
        "conversations": spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n<\\|im_end|>"), (None, 0, None, "x"), (2, None, "assistant", ""), (2, 0, "a\nb%", "t"), (2, 0, "a\nb%", "t")], "conv_id long, turn long, role string, text string"),
        "embeddings": spark.createDataFrame([(0, [1.0, -0.5], 0), (20, [1.0, -0.5], 0), (3, [1.0, -0.5], 0), (4, None, 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0), (7, [1e30, 1.0], 0), (8, [0.25], 0), (None, [1.0, 1.0], 0)], "vec_id long, embedding array<float>, label int"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, data, name):
    assert comparable(QUERIES[name](spark, data).toPandas()) == sql_rows(ORACLE_SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op1_line_frequency"}))  # a list a word of the long text is more than DuckDB can hold
def test_hard_rows_against_sql(spark, odd, name):
    assert comparable(QUERIES[name](spark, odd[0]).toPandas()) == sql_rows(ORACLE_SQL[name], odd[0])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hard_rows_and_empty_tables(spark, odd, name):
    full, empty = (QUERIES[name](spark, d).collect() for d in odd)
    assert len(empty) == (1 if "chat" in name else 0)
    if name.startswith(("op1_", "op4_", "op5_", "op8_", "op9_", "op10_")):
        assert len(full) == len(ROWS)


def test_pipeline_on_hard_rows_and_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd[0])
        assert out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.run(spark, odd[1]).count() == 0
    assert corpus_pipeline.run(spark, odd[0]).count() > 0


def test_packing_round_trip(spark, odd):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = [r for r in ROWS if r[0] is not None] + [(20 + i, f"{PROSE} <|endoftext|> {i} ünï　x y", "", "", 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    got = packing.pack(Work(spark), docs).toPandas()
    ids = {r[0]: np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
    count = {k: np.zeros(len(v), int) for k, v in ids.items()}
    for p in got.itertuples():
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        count[p.doc_id][p.start : p.start + p.length] += 1
    assert all((v == (2 if k == 3 else 1)).all() for k, v in count.items())
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert (got.groupby("sequence_id").length.sum() != 1024).sum() <= 1


def test_packing_of_all_documents(spark, data):
    """Every id of every document in exactly one place, by the tokenizer itself; all windows but one are full."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in docs}
    got = packing.op2_bounded_packing(spark, data).toPandas().sort_values(["doc_id", "start"])
    for doc, own in got.groupby("doc_id"):
        assert (own.start == own.length.cumsum() - own.length).all() and own.length.sum() == len(ids[doc]) and (own.doc_tokens == len(ids[doc])).all()
        assert [zlib.crc32(ids[doc][a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    assert set(got.doc_id) == set(ids)
    lined = got.sort_values(["sequence_id", "offset"])
    assert (lined.groupby("sequence_id").length.cumsum() - lined.length == lined.offset).all()
    full = lined.groupby("sequence_id").length.sum()
    assert (full <= 1024).all() and (full != 1024).sum() <= 1


def test_packing_reads_added_tokens_as_the_tokenizer_does(spark, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  é\n", "<|endoftext", "<|<|endoftext|>|>", None, PROSE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (packing.op2_bounded_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        got = {r.doc_id: (r.start, r.length, r.doc_tokens, r.ids_crc32) for r in got.collect()}
        want = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
        assert got == {i: (0, len(v), len(v), zlib.crc32(v.tobytes())) for i, v in enumerate(want)}


def test_mixing_comes_near_its_targets(spark, data):
    got = mixing.op4_pivotal_mixing(spark, data).toPandas()
    again = mixing.op4_pivotal_mixing(spark, data).toPandas()
    assert sorted(got.itertuples(index=False)) == sorted(again.itertuples(index=False))
    assert (got.taken <= 3 * got["size"]).all() and (got["size"] == 0).sum() == (got.source_size.isna()).sum() + (got["size"] == 0).sum()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source").toPandas()
    by = got.merge(docs, on="doc_id").groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (by["size"] == by.own).all() and ((by.taken - by.target).abs() <= by.most).all()
    total, weight = by.own.sum(), np.array([1, 2, 3] * 10)[: len(by)]
    limit, share = 3.0 * by.own.to_numpy(), np.zeros(len(by))
    free = np.ones(len(by), bool)
    while True:  # the excess is shared again until none is above
        share = np.where(free, (total - limit[~free].sum()) * weight / weight[free].sum(), limit)
        if not (over := free & (share > limit)).any():
            break
        free &= ~over
    assert np.allclose(by.target, share)


def test_pivot_keeps_expectations(spark):
    docs = spark.createDataFrame([(i, 1 + i % 5, "ab"[i % 2]) for i in range(300)], "doc_id long, size long, source string")
    taken = F.sum(F.col("size") * (F.col("n_rows") * F.col("whole") + F.col("n_more")))
    rates = [mixing.copies(Work(spark), docs, (1, 2), seed).groupBy("src").agg(taken.alias("t"), F.first("target").alias("g")).collect() for seed in (1, 2)]
    assert all(abs(r.t - r.g) <= 5 for x in rates for r in x)


def test_mixing_rounds_equal_rows_one_by_one(spark, tmp_path):
    """A source of 1000 equal rows comes within one row of its target; in the mix, too, where equal ids may have different texts."""
    rows = [(7, "w " * 9 + "w", "a")] * 1000 + [(i, "v " * 19 + f"x{i}", "b") for i in range(500)] + [(8, f"u{i % 3} " * 10, "c") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op4_pivotal_mixing(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"] == 0).all()
    by = got.groupby("target").agg(size=("size", "max"), taken=("taken", "sum"))
    assert len(by) == 3 and ((by.taken - by.index).abs() <= by["size"]).all()
    mixed = mixing.mix(Work(spark), docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    goal = {r.src: r.target for r in mixing.copies(Work(spark), docs.withColumn("size", mixing.word_count(F.col("text")))).select("src", "target").distinct().collect()}
    assert {r.source for r in mixed} == set(goal) and all(abs(r.n - goal[r.source]) <= 20 for r in mixed)


def test_hot_units_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 4)
    units = spark.createDataFrame([(1, 5, 11), (2, 5, 1), (3, 0, 4)], "doc_id long, size long, n_rows long")
    got = sorted((r.doc_id, r._place) for r in mixing.rows_again(units, 11).collect())
    assert got == [(1, k) for k in range(11)] + [(2, 0)] + [(3, k) for k in range(4)]


def test_personal_data_rules():
    naive = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for t in ("a@b.c", "x a.b@c-d.e.f, y@z @q.w a@b", "a@b@c.d.", "1.2.3.4.5.6.7.8 300.1.1.1", "a" * 3000, "@" * 3000):
        assert [(a, b) for k, a, b in pii.base_spans(t) if k == "email"] == [m.span() for m in naive.finditer(t)]
    assert pii.base_spans("1.2.3.4.5.6.7.8 300.1.1.1 ") == [("ip", 0, 7), ("ip", 8, 15)]
    assert [k for k, *_ in pii.base_spans("4111-1111 1111 1111")] == ["card"] and pii.base_spans("4111111111111112") == []
    assert [k for k, *_ in pii.base_spans("call +1 (988) 555-2485 now")] == ["phone"]
    assert pii.redact("mail a@b.cd now", [("email", 5, 11)]) == "mail <EMAIL> now"


def naive_spans(text):
    """The contract's four patterns, as written, by the regular expressions of the standard library."""
    luhn = lambda d: sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    count = lambda v: len(re.sub("[^0-9]", "", v))
    tests = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= count(v) <= 19 and luhn(re.sub("[^0-9]", "", v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= count(v) <= 15),
    )
    return [(kind, *m.span()) for kind, p, ok in tests for m in re.finditer(p, text) if ok(m[0])]


def test_personal_data_of_all_documents(spark, data):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op5_bilstm_crf(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        base = naive_spans(docs[r.doc_id])
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 10


def test_personal_data_in_very_long_runs(spark):
    texts = ["0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1", "1.1.1." + "7" * 6000, "+1" + "2" * 9000, "4111 1111 1111 1111 " * 3000, "000.0000.255.00256 x 00.0.0.0"]
    assert [pii.base_spans(t) for t in texts] == [naive_spans(t) for t in texts]
    assert ("ip", 0, 5006) in pii.base_spans(texts[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_ip for r in pii.find(docs).orderBy("doc_id").collect()] == [1, 0, 0, 0, 0, 1]


def test_added_spans_may_go_beyond_base_spans():
    text = "escriba a josé.maría@ejemplo.org para saber más"
    base, spans = pii.all_spans(pii.trained(), [text])[0]
    assert base == [("email", 19, 32)] and ("email", 10, 32) in spans and set(base) < set(spans)
    assert pii.redact(text, spans) == "escriba a <EMAIL> para saber más"
    covered = np.zeros(40, bool)
    covered[5:10] = True
    inside = lambda t, a, b: pii.adds(t.ljust(40), covered, ("email", a, b))
    assert not inside("abcdeabcde.", 5, 11) and inside("abcdeabcdex", 5, 11) and not inside("abcdeabcde", 6, 9) and inside("abcde", 0, 5)
    many = "1.1.1.1" + ".a1.1.1.1" * 12  # addresses inside one local part: the rules' spans overlap, and all count
    base, spans = pii.all_spans(pii.trained(), [f"{many}@mail.org"])[0]
    assert sum(k == "ip" for k, *_ in base) == 13 and [s for s in spans if s not in base and s[0] == "email"] == []


def test_tagger_finds_labelled_spans():
    texts = pii.labelled_texts(150, seed=77)
    found = pii.tagged(pii.trained(), [t for t, _ in texts])
    hits = sum(len(set(s) & set(g)) for (_, s), g in zip(texts, found, strict=True))
    assert hits / sum(len(s) for _, s in texts) > 0.9 and hits / sum(map(len, found)) > 0.9
    long = "no data here " * 3000 + "x@mail1.example.com " + "nor here " * 3000
    assert pii.all_spans(pii.trained(), [long])[0][1] == [("email", 39000, 39019)]


def test_tagger_finds_the_spans_of_decoding_every_window():
    model, mail = pii.trained(), "info@müller-maschinenbau.de"
    texts = [("so und auch " * 10)[k:] + mail + " und so" * 30 for k in range(32)] + [f"ä{'b' * n}@{'c' * n}ü.de und so weiter" for n in range(0, 400, 7)]
    texts += [t for t, _ in pii.labelled_texts(40, seed=78)] + ["@", "é@", "a" * 47 + "@", "", "1" * 100]
    whole = []
    for t in texts:
        y = np.zeros(len(t), np.int8)
        pii.decode(model, [t], {0: np.arange(-1, len(t) // 32 + 1) * 32}, [y], 512)
        whole.append(pii.joined(t, y))
    assert pii.tagged(model, texts) == whole
    assert all(s == [("email", t.index(mail), t.index(mail) + len(mail))] for t, s in zip(texts[:32], whole))


def test_tagger_gradients():
    model = pii.Tagger(1)
    r = np.random.default_rng(0)
    x, y = r.integers(0, pii.PAD, (6, 3)), np.zeros((6, 3), np.int64)
    y[2], y[3] = 1, 2
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        e, trans = model.emissions(x).astype(float), model.p["t"] + model.mask
        a = e[0] + trans[pii.LABELS]
        gold = a[np.arange(3), y[0]].copy()
        for t in range(1, 6):
            gold += trans[y[t - 1], y[t]] + e[t][np.arange(3), y[t]]
            s = a[:, :, None] + trans[: pii.LABELS]
            a = e[t] + np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1)
        return (np.log(np.exp(a - a.max(1, keepdims=True)).sum(1)) + a.max(1) - gold).sum() / 18

    g = model.gradients(x, y)
    for name in ("o", "uf", "wb", "e"):
        k = (0, 1)
        model.p[name][k] += 1e-3
        up = loss()
        model.p[name][k] -= 2e-3
        down = loss()
        model.p[name][k] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][k]) < 2e-3


def test_chat_layouts_and_escapes():
    text = "<|im_end|> <\\|x <\\\\| < |"
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    turns = [("user", text), ("assistant", ""), ("a\nb%", text)]
    formatted, mask = chat.render(turns)
    assert chat.parse(formatted) == turns and len(mask) == 1
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"prompt": "q", "response": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"question": "q", "answer": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": {"text": "q"}, "completion": {"text": "a"}},
    ):
        assert chat.canonical(record, chat.select(record)) == want
    assert chat.select({"unknown": 1}) is None


def test_unknown_layouts_are_kept_apart(spark):
    df = spark.createDataFrame([(1, 0, "no json"), (1, 1, None), (1, 2, '{"prompt": "p", "completion": "c"}'), (1, 3, "[1]")], "conv_id long, seq long, record string")
    assert [r.layout for r in chat.format_chat(df).orderBy("seq").collect()] == ["unknown", "unknown", "prompt_completion", "unknown"]


def test_warc_round_trip(spark, odd):
    work = Work(spark)
    pages = spark.read.parquet(f"{odd[0]}/pages.parquet").select("page_id", "url", F.col("html").alias("payload"))
    path = work.path("w")
    warc.write(work, pages, path, piece=300, pieces=2)
    rows = warc.read(work, path).collect()
    assert len(rows) == 6 and {r.response.type for r in rows} == {"response", "revisit"}
    by = {r.metadata.page_id: r for r in rows}
    assert bytes(by[4].response.payload) == b"WARC/1.1\r\n\r\nx\r\n\r\n" and by[1].response.refers_to.startswith("urn:page:2:")
    assert by[2].response.digest == base64.b32encode(hashlib.sha1(b"<p>same</p>").digest()).decode()
    with pytest.raises(ValueError):
        list(warc.records(BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx")))


def test_top_k_by_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.integers(-3, 4, (300, 4)) / 64
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    got = topk.top_k(Work(spark), topk.integral(rows), F.col("vec_id") % 20 == 0, k=7).toPandas()
    w = np.floor(v * 64).astype(int)
    for q in range(0, 300, 20):
        s = w @ w[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:7]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == best and own.score.tolist() == [s[i] for i in best]


def test_toxicity_held_out(spark):
    r = np.random.default_rng(2)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, 6))
    rows = [(i, " ".join([word() for _ in range(30)] + ["vilewords"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    model = toxicity.fit(Work(spark), docs, labels, sample=200)
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    score = model.score([x[1] for x in held])
    assert np.mean((score >= 0.3) == [x[2] == 1 for x in held]) > 0.98
    assert 0 <= model.score([""])[0] < 0.3
    assert np.allclose(model.score([x[1] for x in rows[:50]] + ["", "ünï" * 400]), [naive_score(model, t) for t in [x[1] for x in rows[:50]] + ["", "ünï" * 400]])


@cache
def bucket_of(gram):
    return int(toxicity.buckets(np.array([ord(c) for c in gram], np.uint32), len(gram))[0])


def naive_score(model, text):
    """Logistic of the bias and the weights of the distinct n-grams, each hashed on its own."""
    framed = f" {text.lower()} "
    seen = {bucket_of(framed[k : k + n]) for n in toxicity.ORDERS for k in range(len(framed) - n + 1)}
    return 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[b]) for b in seen))))


def test_toxicity_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int")
    rows, counts = toxicity.train_rows(Work(spark), docs, labels, 10)
    assert rows.count() == 20 and sum(counts.values()) < 40
    assert sorted(rows.collect()) == sorted(toxicity.train_rows(Work(spark), docs.repartition(7), labels, 10)[0].collect())


def test_toxicity_of_all_documents(spark, data):
    """The query's scores are those of the n-grams counted one by one; labels of the held-out quarter change nothing."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model, other = (toxicity.fit(Work(spark), docs, x) for x in (labels, flipped))
    assert model.bias == other.bias and (model.weights == other.weights).all()
    got = {r.doc_id: r for r in toxicity.op8_nb_ngram_toxicity(spark, data).collect()}
    rows = [r for r in docs.collect() if len(r.text or "") < 3000]
    assert len(got) == docs.count() and np.allclose([got[r.doc_id].score for r in rows], [naive_score(model, r.text or "") for r in rows], atol=1e-5)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in got.values())


def brute_components(rows):
    """(number of shingles, least id reachable) of each row (id, text), comparing all pairs of sets."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), own) if x is not None) if own is not None or find(i) in least else None
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def near_rows():
    r = np.random.default_rng(3)
    base, rows = [f"w{k}" for k in r.integers(0, 5000, 120)], []
    for i in range(260):  # a dense group around the threshold, larger than a block of sets
        w = list(base)
        for k in r.choice(120, r.integers(0, 6), replace=False):
            w[k] = f"n{i}_{k}"
        rows.append((i, " ".join(w)))
    return rows + [(1000 + i, " ".join(f"u{k}" for k in r.integers(0, 5000, 40))) for i in range(30)] + [(2000, "A b"), (2001, "a  B"), (2002, ""), (2003, None)]


def test_near_duplicates_by_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(Work(spark), docs).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_components(rows), strict=True))


def test_near_duplicates_where_ids_repeat(spark):
    """Rows of one id are told apart by their texts: each is linked as its text is, and of every group one row stays."""
    a, b = PROSE, " ".join(f"other{k}" for k in range(50))
    rows = [(5, a), (5, b), (6, a + " tail"), (6, "alone and short"), (5, a), (5, a.upper()), (4, b + " end"), (9, ""), (9, ""), (9, None), (None, a), (None, ""), (3, "one two"), (3, "one two"), (2, "three four"), (7, "one  TWO")]
    rows += [(i % 50, t) for i, t in near_rows()[:200]]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    found = neardup.near_duplicates(Work(spark), docs)
    want = brute_components(rows)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(i, n, None if i is None else c) for (i, _), (n, c) in zip(rows, want, strict=True)], key=str)
    kept = neardup.keep_one(Work(spark), docs)
    assert kept.columns == docs.columns
    kept = [r.n for r in kept.collect()]
    assert len(kept) == len(set(kept))
    free = [n for n, (i, t) in enumerate(rows) if i is None or not (t or "").split()]
    assert set(free) <= set(kept)
    # A group is a component of texts; brute force names groups by their least id, which texts apart may share, so group anew.
    texts = {}
    for n, (i, t) in enumerate(rows):
        if n not in free:
            texts.setdefault(" ".join(t.lower().split()), []).append(n)
    groups = brute_components([(k, t) for k, t in enumerate(texts)])
    of = {n: groups[k][1] for k, own in enumerate(texts.values()) for n in own}
    members = {}
    for n, g in of.items():
        members.setdefault(g, []).append(n)
    for own in members.values():
        (one,) = [n for n in own if n in kept]
        assert rows[one][0] == min(rows[n][0] for n in own)


def rendezvous(key, weights):
    """The shard of the highest weight / -ln(u), u drawn from the hash of key and shard."""
    u = lambda s: ((xxhash.xxh64_intdigest(s.to_bytes(4, "little"), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)) >> 11) + 0.5) / 2**53
    return max(range(len(weights)), key=lambda s: weights[s] / -np.log(u(s)))


def test_shards(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    share = sharding.shard_by_key(docs, [1.0, 3.0]).groupBy("shard").count().orderBy("shard").collect()
    assert 0.2 < share[0][1] / 4000 < 0.3
    own = {r.doc_id: (r["shard"], r.grown_shard) for r in sharding.shard_by_key(docs, [1.0, 3.0]).limit(200).collect()}
    assert own == {i: (rendezvous(i, [1.0, 3.0]), rendezvous(i, [1.0, 3.0, 1.0])) for i in own}


def test_shards_of_all_documents(spark, data):
    got = sharding.op10_rendezvous_shards(spark, data).toPandas()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(got.doc_id) == sorted(docs) and set(got.law) == {"key"}
    for r in got.itertuples():
        text = docs[r.doc_id]
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(text) + 8, zlib.crc32(text), rendezvous(r.doc_id, [1.0] * 24), rendezvous(r.doc_id, [1.0] * 25))
    assert (got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s))))).all()
    assert set(got[got.grown_shard != got["shard"]].grown_shard) <= {24}


def test_line_filter_rejects_depleted_documents(spark):
    rows = [(i, "shared boilerplate line\n" * 2 + f"own {i}", "h") for i in range(6)] + [(9, "all of this text is its own\nshared boilerplate line", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = {r.doc_id: r.depleted for r in quality.line_filter(Work(spark), docs, max_docs=5).collect()}
    assert got == {**{i: True for i in range(6)}, 9: False}


def test_line_filter_removes_frequent_lines(spark, data):
    rows = [(i, f"Shared   LINE\n\nown {i}\nshared line\n", "h") for i in range(4)] + [(3, "Shared   LINE\n\nown 3\nshared line\n", "h"), (5, "shared line\nx", "g"), (6, "shared line", "h"), (None, None, None), (7, "", "h")]
    rows += [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    seen = {}
    for k, (_, t, host) in enumerate(rows):
        for x in (t or "").split("\n"):
            seen.setdefault((host, norm(x)), set()).add(k)
    want = []
    for i, t, host in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not norm(x) or len(seen[host, norm(x)]) <= 5]
        want.append((i, None if t is None else "\n".join(left), sum(len(x) for x in lines if norm(x)) - sum(len(x) for x in left if norm(x))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string").repartition(3)
    got = [(r.doc_id, r.text, r.removed_chars) for r in quality.line_filter(Work(spark), docs, max_docs=5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (0, "\nown 0\n", 24) in got and (6, "", 11) in got and sum(n > 0 for *_, n in got) == 6


def test_pipeline_stages_by_brute_force(spark, data):
    """Each stage on what the one before it keeps: scores, sets, spans, copies and ids taken one by one."""
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{data}/documents.parquet").cache()
    rows = docs.collect()
    model = toxicity.fit(Work(spark), docs.select("doc_id", "text"), spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic"))
    kept = [r for r in rows if model.score([r.text or ""])[0] < 0.3]
    clean = stages["toxicity"](spark, docs, data)
    assert clean.columns == docs.columns and sorted(clean.collect()) == sorted(kept)

    found = brute_components([(r.doc_id, r.text) for r in kept])
    one = stages["near_duplicates"](spark, spark.createDataFrame(kept, docs.schema), data).collect()
    assert sorted(one) == sorted(r for r, (_, c) in zip(kept, found, strict=True) if r.doc_id == c)

    texts = [r.text for r in one]
    spans = [s for _, s in pii.all_spans(pii.trained(), [t or "" for t in texts])]
    red = stages["personal_data"](spark, spark.createDataFrame(one, docs.schema), data).collect()
    want = {r.doc_id: t if t is None else pii.redact(t, s) for r, t, s in zip(one, texts, spans, strict=True)}
    assert {r.doc_id: r.text for r in red} == want and all(r.n_chars == len(r.text) for r in red if r.text is not None)
    assert not any(naive_spans(t or "") for t in want.values())

    mixed = stages["mixing"](spark, spark.createDataFrame(red, docs.schema), data).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in red}
    assert set(mixed) <= set(red) and max(mixed.count(r) for r in red) <= 3
    got = mixing.copies(Work(spark), spark.createDataFrame(red, docs.schema).withColumn("size", F.create_map(*[F.lit(x).cast("long") for kv in size.items() for x in kv])[F.col("doc_id")])).collect()
    assert sum(size[r.doc_id] for r in mixed) == sum(r.size * (r.whole + r.n_more) for r in got)
    assert {r.doc_id: mixed.count(r) for r in red} == {r.doc_id: r.whole + r.n_more for r in got}

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stages["packing"](spark, spark.createDataFrame(mixed, docs.schema), data).toPandas()
    ids = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed}
    assert pieces.length.sum() == sum(ids[r.doc_id] for r in mixed) and (pieces.groupby("sequence_id").length.sum() != 1024).sum() <= 1


def test_work_needs_a_shared_folder(spark):
    class Cluster:
        conf, sparkContext = {}, type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError):
        Work(Cluster)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    work = Work(spark)
    first, second = (work.save(spark.range(n), "same") for n in (3, 4))
    assert (first.count(), second.count()) == (3, 4)
    assert work.save(second, "end", last=True).count() == 4 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ|does not exist"):
        spark.read.parquet(work.made[0]).count()


def test_line_frequency_by_brute_force(spark, odd, tmp_path):
    """All figures of the hard rows, with a line that 21 documents of one host have, and that other hosts have less often."""
    rows = [(r[0], r[1], r[3]) for r in ROWS] + [(100 + i, f"A  frequent\tline\nown text {i} " + "pad " * 20, "h") for i in range(21)] + [(130 + i, "a frequent line\nx # $", "g") for i in range(20)]
    rows += [(200, " ".join(f"w{k % 9}" for k in range(60)) + "\na\n a\na", "g"), (201, "a frequent line\n" * 3, "h"), (202, "one two three four five six seven eight " * 2, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    blank = " \t\n\x0b\x0c\r"
    norm = lambda x: " ".join(re.findall(f"[^{blank}]+", x)).lower()
    seen = {}
    for k, (_, t, host) in enumerate(rows):
        for x in (t or "").split("\n"):
            seen.setdefault((host, norm(x)), set()).add(k)
    want = []
    for doc, t, host in rows:
        t = t or ""
        w, lines = re.findall(f"[^{blank}]+", t), [x for x in t.split("\n") if norm(x)]
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = {g: 0 for g in grams}
        for g in grams:
            n[g] += 1
        repeated = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(8)}
        gone = sum(len(x) for x in lines if len(seen[host, norm(x)]) > 20)
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        want.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), failed, not failed and gone <= 0.5 * sum(map(len, lines)), gone))
    got = quality.op1_line_frequency(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(x[8] > 0 for x in want) == 22
