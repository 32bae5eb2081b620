"""Surrogates, reply trees, toxicity, WARC derivatives and the pipeline."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from finelens.llm import pii_surrogates as P
from finelens.llm import queries, reply_trees, toxicity_mil, warc_derivatives
from tests.conftest import SF001

from . import brute

CLASH = "id long, kind string, mention string, type string, part int, canon string, tree string"


def table(spark, rows):
    data = [(i, t, 1, "k", "m", "t", 2, "c", "d") for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, {CLASH}").repartition(3)


PII = [
    (1, "Mail JOHN.DOE@EXAMPLE.COM or john.doe@example.com, x@b.org. Call +1 (743) 555-3824 or +1 743 555 3824."),
    (2, "Mrs. Anna Smith met Mr. Smith and Dr. Smith; John Smith too. Г-жа Анна Петрова? Господин Петрова."),
    (3, 'SSN 123-45-6789 ip 10.0.0.1, card 4111 1111 1111 1111 and 4111111111111111 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"!'),
    (4, None), (5, ""), (6, "Nothing here but 12 eggs."), (6, "Nothing here but 12 eggs."), (None, "x@b.org again x@b.org"),
    (7, "y" * 200_000 + " 10.0.0.1 " + "z" * 100_000), (8, "mail x@b.org"), (8, "mail x@b.org"),
]


def test_surrogates(spark):
    docs = table(spark, PII)
    rows = P.replaced(docs).collect()
    assert len(rows) == len(PII)
    out = {r["doc_id"]: r["text"] for r in rows}
    assert out[4] is None and out[5] == "" and out[6] == PII[5][1]
    whole = "\n".join(t for t in out.values() if t)
    for secret in ("JOHN.DOE", "john.doe", "b.org", "555", "Smith", "Петров", "123-45-6789", "10.0.0.1", "4111", "24be6443"):
        assert secret not in whole
    # coreference: case, layout, surname alone
    upper, lower, third = re.findall(r"\S+@\S+?\.(?:example|EXAMPLE)\b", out[1])
    assert upper.lower() == lower and upper.isupper() and third != lower
    first, second = re.findall(r"\+1[ (\d)-]+\d", out[1])
    assert re.sub(r"\D", "", first) == re.sub(r"\D", "", second) and first.count("(") == 1 and second.count("(") == 0
    names = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) and Dr\. (\w+); (\w+) (\w+) too\. Г-жа (\w+) (\w+)\? Господин (\w+)\.", out[2]).groups()
    assert names[1] == names[2] == names[3] == names[5] and names[7] == names[8]
    assert names[0].endswith("a") and not names[4].endswith("a") and re.fullmatch("[А-Яа-я]+", names[6])
    spaced, plain = re.search(r"card ([\d ]+) and (\d+) ", out[3]).groups()
    assert spaced.replace(" ", "") == plain and luhn(plain) == luhn("4111111111111111")
    assert re.search(r'token = "[0-9a-f]{40}"!', out[3])
    assert out[8] == "mail " + third.rstrip(".") and out[None].split()[0] == third.rstrip(".")
    for r in rows:
        for s in r["__pii"]:
            mention = r["text"][s["start"] : s["start"] + s["length"]]
            assert regex.fullmatch(P.PATTERNS[s["type"]], mention) or s["type"] == "person", mention
    done = P.anonymised(docs)
    assert done.columns == docs.columns and P.replaced(docs.where("1 = 0")).count() == 0


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def test_surrogates_stay_distinct(spark, monkeypatch):
    # a generator of 200 values, some of them real entities: losers must draw again
    ents = spark.createDataFrame([("ip", str(i), "-") for i in range(150)], "kind string, canon string, gender string")
    few = F.pmod(F.xxhash64("canon", "attempt"), F.lit(400)).cast("string")
    monkeypatch.setattr(P, "surrogate", lambda key: few)
    got = P.assign(ents, "k").collect()
    assert len({r["surrogate"] for r in got}) == 150
    assert not {r["surrogate"] for r in got} & {str(i) for i in range(150)}


LAYOUTS = {
    "phone": ["415 555 2671", "(415) 555 2671", "415 555-2671", "(415) 555-2671", "415-555-2671"],
    "card": ["3782 822463 10005", "3782-822463-10005", "378282246310005"],
    "ip": ["2001:db8:85a3::8a2e:370:7334", "2001:0DB8:85A3:0:0:8A2E:0370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"],
}


def test_layouts_of_one_entity_share_a_surrogate(spark):
    shown = {k: [f"see {m}. or ({m}), node:{m}: end" if k == "ip" else f"see {m}. or [{m}], end" for m in ms] for k, ms in LAYOUTS.items()}
    rows = [(i, t) for i, t in enumerate(t for ts in shown.values() for t in ts)]
    plain = [
        "x[100:200:2] a[1::2] std::vector 12:34:56 00:1a:2b:3c:4d:5e add::", "table 100 200 3000 and 12 345 678 9012",
        "fe80:: and 43:51:43:a1:b5:fc:8b:b7:0a:3a:a9:b1:0f:66:73:a8 and 1 2 3", "on 2024 123456 78 in 1999",
    ]
    out = {r["doc_id"]: r for r in P.replaced(table(spark, rows + [(100 + i, t) for i, t in enumerate(plain)])).collect()}
    i = 0
    for kind, texts in shown.items():
        seen = set()
        for m in LAYOUTS[kind]:
            r = out[i]
            assert m not in r["text"] and {s["type"] for s in r["__pii"]} == {kind}, r
            assert len(r["__pii"]) == (3 if kind == "ip" else 2), r
            seen |= {re.sub(r"[^0-9a-z:]", "", r["text"][s["start"] : s["start"] + s["length"]]) for s in r["__pii"]}
            i += 1
        assert len(seen) == 1, seen
    assert [out[100 + k]["text"] for k in range(len(plain))] == plain


def test_short_emails_never_run_out_of_surrogates(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{c}@x.com" for c in letters] + [f"{c}@{c}.{tld}" for c in letters for tld in ("com", "org")] + ["_@y.net", "+@y.net"]
    ents = P.entities_of(spark.createDataFrame([(m,) for m in mails], "mention string"))
    real = {(r["kind"], r["canon"]) for r in ents.collect()}
    draws = []

    def bounded(*args, made=P.stored):
        draws.append(args)
        assert len(draws) < 40, "the draws do not end"
        return made(*args)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "stored", bounded)
        got = {(r["kind"], r["canon"]): r["surrogate"] for r in P.assign(ents, "k").collect()}
    assert set(got) == real
    assert len({(k, s) for (k, _), s in got.items()}) == len(got)
    assert not {(k, s) for (k, _), s in got.items()} & real
    assert all(re.fullmatch(r"[a-z_+]{2,4}@x\.com", got["email", f"{c}@x.com"]) for c in letters)


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "\\", "<", "[", "\n", "s>", "/INST]", "x", "<|im_end|"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = reply_trees.escaped(F.col("t"))
    r = reply_trees.escaped_role(F.col("t"))
    bad = df.where(
        (reply_trees.unescaped(e) != F.col("t")) | (reply_trees.unescaped_role(r) != F.col("t")) | r.contains("\n")
        | e.rlike(r"<\|im_end\|>|</?s>|\[/?INST\]")
    )
    assert bad.count() == 0


def test_conversations_match_brute_force(spark):
    control = "</s>[INST] ok [/INST]<|im_end|>\n<|im_start|>assistant\n\\"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", control), (1, 2, "user", None), (1, 2, "user", None), (1, 3, "assistant", "a" * 50_000),
            (2, None, None, "lone"), (None, 0, "system", "s"), (None, 1, "assistant", ""), (3, 5, "user\n", control)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} é") for i in range(70)]
    data = [(*r, "extra", 1) for r in rows]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, node string, tree long")
    got = {r["conv_id"]: r for r in reply_trees.conversation_digests(df.select("conv_id", "turn", "role", "text")).collect()}
    assert set(got) == {1, 2, None, 3, 9}
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, x or "", y or "") for c, t, x, y in rows if c == conv))
        turns = [(x, y) for _, _, x, y in own]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha256("".join(f"{x}\n{y}\n" for x, y in turns).encode()).hexdigest()
        loss = "".join(y for x, y in turns if x == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha256(loss.encode()).hexdigest())
    assert reply_trees.conversation_digests(df.where("1 = 0")).count() == 0


def test_branches_are_ranked(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> (5 | 6), a cycle 7 <-> 8 with leaf 9, an orphan 10
    edges = [(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 2, 0), (5, 3, 2), (6, 3, None), (7, 8, 9), (8, 7, 9), (9, 7, 9), (10, 99, 0.5)]
    df = spark.createDataFrame([("t", n, p, "user", f"m{n}", None if s is None else float(s)) for n, p, s in edges],
                               "tree string, node long, parent long, role string, text string, score double")
    out = reply_trees.chosen_paths(df, top=3).collect()
    assert [(r["leaf"], r["rank"], [t["text"] for t in r["turns"]]) for r in sorted(out, key=lambda r: r["rank"])] == [
        (5, 1, ["m1", "m3", "m5"]), (4, 2, ["m1", "m2", "m4"]), (10, 3, ["m10"]),
    ]


def test_noisy_or_learns_from_document_labels():
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(400)]

    def doc(toxic: bool) -> str:
        sents = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randint(2, 30))]
        if toxic:
            sents[rng.randrange(len(sents))] += " " + rng.choice(["Badword", "vile", "nasty!"])
        return ". ".join(sents) + "."

    labels = [rng.random() < 0.2 for _ in range(900)]
    texts = [doc(y) for y in labels]
    model = toxicity_mil.train(pa.array(texts[:600]), [float(y) for y in labels[:600]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(302)), pa.array([*texts[600:], None, ""])], ["doc_id", "text"])
    out = next(toxicity_mil.scorer(model)([batch])).to_pylist()
    assert [r["score"] >= toxicity_mil.THRESHOLD for r in out[:300]] == labels[600:]
    for r, t, y in zip(out, texts[600:], labels[600:]):
        spans = [t[s["start"] : s["start"] + s["length"]].lower() for s in r["sentences"]]
        assert not y or (spans and all(re.search("badword|vile|nasty", s) for s in spans))
    assert 0 <= out[300]["score"] < 0.1 and out[300]["score"] == out[301]["score"]
    assert toxicity_mil.train(pa.array([], pa.string()), []).leak == 0.0


def test_toxicity_held_out_accuracy(spark):
    out = queries.QUERIES["op8_toxicity_mil"](spark, SF001.replace("0.001", "0.01")).collect()
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF001.replace('0.001', '0.01')}/labels.parquet").to_pylist()}
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)
    docs = table(spark, [(1, "a b"), (None, None), (1, "")])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert [(r["score"], r["predicted"]) for r in toxicity_mil.scored(docs, none).collect()] == [(0.0, 0)] * 3
    assert toxicity_mil.scored(docs.where("1 = 0"), none).count() == 0


def test_warc_derivatives(spark):
    page = '<html lang="fr"><head><title>A &amp; B</title><script>x("</p>")</script></head><body><p>One&nbsp;é\r\n two</p><!-- no --><a href="/q?a=1&amp;b=2">l<b>in</b>k</a></body></html>'
    rows = [(1, "http://a/ x\r\ny", page), (2, None, None), (2, None, None), (None, "http://b", ""), (4, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\nWARC-Type: fake " * 50)]
    df = spark.createDataFrame([(*r, "i", 7) for r in rows], "page_id long, url string, html string, id string, record_id int").repartition(2)
    recs = warc_derivatives.round_trip(warc_derivatives.responses(df))
    got = warc_derivatives.checked(recs).collect()
    assert len(got) == 2 * len(rows) and all(r["digest_ok"] and r["length_ok"] for r in got)
    own = {(r["id"], r["record_type"]): r for r in recs.collect()}
    conv, meta = own[1, "conversion"], own[1, "metadata"]
    assert conv["block"] == "A & B\nOne é\ntwo\nlink"
    assert conv["refers_to"] == meta["refers_to"] and conv["record_id"] != meta["record_id"]
    assert conv["target_uri"] == "http://a/%20x%0D%0Ay" and own[2, "metadata"]["target_uri"] is None
    assert conv["source_digest"] == "sha256:" + sha256(page.encode()).hexdigest()
    assert "title: A & B\n" in meta["block"] and "outlink: /q?a=1&b=2\n" in meta["block"] and "source-header: Content-Type: text/html" in meta["block"]
    assert (None, "conversion") in own and own[2, "conversion"]["block"] == ""
    assert warc_derivatives.round_trip(warc_derivatives.responses(df.where("1 = 0"))).count() == 0


@pytest.fixture(scope="module")
def sf001_docs():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF001}/documents.parquet").to_pylist()}


def test_pipeline_matches_brute_force(spark, sf001_docs):
    import corpus_pipeline

    clean = {d: q["clean_text"] for d, t in sf001_docs.items() if (q := brute.quality(t))["kept"]}
    first: dict = {}
    for d in sorted(clean):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", clean[d]), d)
    single = {d: clean[d] for d in first.values()}
    comp = brute.near_components(single, corpus_pipeline.NEAR_WORDS)
    want = {d for d in single if comp[d] == d}
    out = corpus_pipeline.run(spark, SF001).collect()
    assert {r["doc_id"] for r in out} == want
    from tests.llm.test_tokens import check_packed

    check_packed(out)
    # the stage's tokens are those of its texts with surrogates
    import public_tokenizers
    from tokenizers import Tokenizer

    kept = spark.createDataFrame([(d, single[d]) for d in sorted(want)], "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in P.anonymised(kept).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size: dict = {}
    for r in out:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["length"]
    assert size == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in masked.items()}


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "pii_surrogates", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF001).columns == docs.columns


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, a long text, columns named like the stages' own; then no rows at all."""
    import corpus_pipeline

    line = "Here stands a line of plain text number {} that says quite enough to be kept by all rules."
    rows = [(i, line.format(f"n{i} with words w{i}a w{i}b w{i}c"), i) for i in range(6)]
    rows += [rows[0], (None, rows[1][1], 0), (None, line.format("nobody else has this one, x y z"), 0), (7, None, 0), (8, "", 0), (None, None, 0)]
    rows += [(9, "\n".join(" ".join(f"v{k}w{j}" for j in range(9)) + "." for k in range(3000)), 0)]
    odd = "`__node` long, `__q` long, `__key` long, `__pii` long, c0 long"
    data = [(d, t, "en", "s", len(t or ""), k, 1, 2, 3, 4) for d, t, k in rows]
    docs = spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {odd}")
    docs.repartition(3).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert sorted({str(r["doc_id"]) for r in out}) == ["0", "1", "2", "3", "4", "5", "9", "None"]
    assert sum(r["piece"] == 0 for r in out) == 8  # one row of each text
    pieces = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 9)
    assert len(pieces) > 3 and [s for _, s, _ in pieces] == [4096 * p for p, _, _ in pieces]
    docs.where("1 = 0").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    none = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == [*out[0].asDict()]
