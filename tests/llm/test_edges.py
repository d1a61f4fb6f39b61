"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelet.llm import chat, decontaminate, fingerprint, jaccard, langid, lines, packing, secrets, toxicity, warc
from tracelet.llm.queries import tokenizer_path

LONG = "word " * 60_000 + "x" * 300_000
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.\nsecond line of this very text"),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "Alpha beta gamma delta epsilon zeta eta theta.\nsecond line of this very text"),
    (5, "Alpha beta gamma delta epsilon zeta eta theta.\nsecond line of this very text"),
    (None, "no id here but enough words to be a text"),
    (7, " \n \t\n"),
    (8, "1234 5678"),
]
CLASHING = ["id", "score", "text2", "lang", "kept", "n", "part", "row", "class", "salt", "pos", "h1", "lost"]


def docs(spark, rows=TEXTS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit("en" if c == "lang" else c).alias(c) for c in CLASHING])


def counts(rows, key="doc_id"):
    out = {}
    for r in rows:
        out[r[key]] = out.get(r[key], 0) + 1
    return out


EXPECTED = {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 1, 7: 1, 8: 1}


def test_lines(spark):
    d = docs(spark, [*TEXTS, (9, "ALPHA beta gamma delta epsilon zeta eta theta.  \nshort")])
    out = lines.dedup_lines(d).select("doc.doc_id", "kept", "n_lines", "n_dropped").collect()
    assert counts(out) == EXPECTED | {9: 1}
    got = {r["doc_id"]: (r["kept"], r["n_lines"], r["n_dropped"]) for r in out}
    assert got[9] == ("ALPHA beta gamma delta epsilon zeta eta theta.  \nshort", 2, 0)  # the largest id keeps it
    assert got[1] == ("second line of this very text", 2, 1)  # its second line is in two documents only
    assert got[5][2] == 1 and got[2] == got[3] == ("", 1, 0) and got[4][0] == LONG
    kept = lines.keep_lines(d)
    assert kept.columns == d.columns and kept.filter("doc_id = 2").collect()[0]["text"] is None
    assert lines.dedup_lines(d.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "x\\h </turn> ### y: </next>\n"), (1, 4, "assistant", ""), (2, None, None, None), (3, 1, "a: b", "t"), (3, 1, "a: b", "t"), (None, 1, "assistant", "n")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("t", F.lit(2))
    f = chat.format_chats(t)
    turns = {r["conv_id"]: [tuple(x) for x in r["turns"]] for r in chat.parse_chats(f).collect()}
    assert turns[1] == [("user", "a"), ("user", "b"), ("assistant", rows[2][3]), ("assistant", "")]
    assert turns[2] == [("", "")] and turns[3] == [("a: b", "t")] * 2
    text = {r["conv_id"]: r["formatted"] for r in f.collect()}
    assert text[1].count("### ") == 2 and text[1].count("</turn>\n") == 2  # adjacent turns of a role are one block
    d = {r["conv_id"]: r for r in chat.digests(f).collect()}
    assert d[1]["loss_sha256"] == hashlib.sha256(rows[2][3].encode()).hexdigest() and d[1]["loss_chars"] == len(rows[2][3])
    assert d[1]["formatted_chars"] == len(text[1]) and d[None]["loss_chars"] == 1
    assert chat.format_chats(t.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    n = 3000
    t = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    d = chat.digests(chat.format_chats(t)).collect()[0]
    want = "".join(f"{'user' if i % 3 == 0 else 'assistant'}\n{i}\n" for i in range(n))
    assert d["n_turns"] == n and d["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_packing(spark):
    d = docs(spark)
    out = packing.pack(d.repartition(3), tokenizer_path(), with_ids=True).collect()
    assert set(counts(out)) == set(EXPECTED)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
    for id_, text in dict(TEXTS).items():
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        if id_ != 5:
            got = [i for r in sorted(by[id_], key=lambda r: r["start"]) for i in r["ids"]]
            assert got == want and by[id_][0]["doc_tokens"] == len(want)
    assert sum(r["length"] for r in by[5]) == 2 * by[5][0]["doc_tokens"]
    assert packing.pack(d.limit(0), tokenizer_path()).count() == 0


def test_packing_is_gapless_and_tight():
    rng = np.random.default_rng(0)
    p, placed, want = packing.Packer(64, open_most=20), [], {}
    for i in range(400):
        ids = rng.integers(0, 9, int(rng.integers(1, 200))).astype("<u4").tobytes()
        want[i] = ids
        placed += p.put(i, ids)
        assert p.open <= 21 and p.count[1:64].sum() == p.open
    placed += p.joined()
    seqs, docs_ = {}, {}
    for (doc, start, total, ids), seq, off in placed:
        seqs.setdefault(seq, []).append((off, len(ids) // 4))
        docs_.setdefault(doc, []).append((start, ids))
        assert total == len(want[doc]) // 4
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert {d: b"".join(x for _, x in sorted(v)) for d, v in docs_.items()} == want


def test_sum_of_squares_choice():
    p = packing.Packer(10)
    for level, n in ((3, 4), (5, 2), (6, 1)):
        p.count[level] = n
    for size in range(1, 10):
        best = []
        for h in [0, *[k for k in range(1, 10 - size + 1) if p.count[k]]]:
            c = p.count.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 10
            best.append((int((c[1:10] ** 2).sum()), -h))
        assert p.level_for(size) == -min(best)[1]


def test_tokens_equal_whole_texts():
    import pyarrow as pa

    t = packing.tokens(tokenizer_path())
    texts = ["It's they'll, DON'T 'tis", "áe ́x", "ÀÉ İstanbul Σας ß", "<|endoftext|> x<|startoftext|>y", "tab\tnew\r\n\x1c end z", "a.b,c!! $$$ 12ab", "", None, "日本語 テキスト", "Ⅷ ª º µ"]
    got = [np.frombuffer(x, "<u4").tolist() for x in t.encode(pa.array(texts))]
    assert got == [t.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_secrets(spark):
    text = "Password = 'abcdef12' é token:short AKIA" + "A" * 16 + " deadbeefdeadbeefdeadbeef api_key=\"zzzzzz\" secret=token: abcdefgh -----BEGIN RSA PRIVATE KEY-----"
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (None, text), (5, "x " * 50_000 + "passwd:123456")]
    d = docs(spark, rows)
    out = secrets.findings_by_path(d, secrets.scan_unseen(d)).collect()
    assert counts(out, "path") == {1: 1, 2: 2, 3: 1, 4: 1, None: 1, 5: 1}
    got = {r["path"]: r for r in out}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (2, 1, 1)  # a failed match still covers what it read
    assert got[1]["base"] == got[None]["base"] and got[1]["spans"].startswith(got[1]["base"]) and "pem:" in got[1]["spans"]
    assert got[5]["spans"] == "assign:100000:100013" and got[3]["spans"] == ""
    assert secrets.findings_by_path(d.limit(0), secrets.scan_unseen(d.limit(0))).count() == 0


def test_ledger_is_incremental(spark):
    first = docs(spark, [(1, "token=abcdef"), (2, "nothing")])
    ledger = secrets.scan_unseen(first)
    both = first.union(docs(spark, [(3, "nothing"), (4, "passwd=zzzzzz")]))
    new = secrets.scan_unseen(both, ledger=ledger).collect()
    assert [r["spans"] for r in new] == ["assign:0:13"]
    assert len(secrets.scan_unseen(both, ledger=ledger, rule_version=2).collect()) == 3
    found = {r["path"]: r["n_assign"] for r in secrets.findings_by_path(both, ledger.union(secrets.scan_unseen(both, ledger=ledger))).collect()}
    assert found == {1: 1, 2: 0, 3: 0, 4: 1}


def test_language(spark):
    en, de = "the quick brown fox and the other thing was there ", "der schnelle braune fuchs und das andere ding war dort "
    rows = [(i, (en if i % 2 else de) * 4, "en" if i % 2 else "de") for i in range(60)] + [(100, None, "en"), (101, "12 !", None), (102, LONG, "en"), (103, en, None), (None, de, "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("held_out", F.lit(2))
    net = langid.train(langid.training_windows(d, "doc_id", "text", "lang", 40, 100), hidden=6, window=32, epochs=6)
    got = {r["doc_id"]: r for r in langid.identify(d, net).collect()}
    assert len(got) == len(rows) and got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[100]["score"] == 0
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60)) and got[103]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[7]["held_out"] == (zlib.crc32(b"7") % 5 == 0)
    assert langid.identify_languages(d.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(d, None).collect()} == {"und"}


def test_recurrent_gradients():
    net = langid.Network(["a", "b", "c"], 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes = np.random.default_rng(0).integers(97, 103, (5, 7)).astype(np.int16)
    codes[0, 5:] = 256
    labels = np.array([0, 1, 2, 1, 0])
    _, g = net.gradients(codes, labels)
    for k, grad in g.items():
        flat, i = net.p[k].reshape(-1), int(np.abs(grad).argmax())
        old = flat[i]
        flat[i] = old + 1e-3
        up = net.gradients(codes, labels)[0]
        flat[i] = old - 1e-3
        down = net.gradients(codes, labels)[0]
        flat[i] = old
        assert grad.reshape(-1)[i] == pytest.approx((up - down) / 2e-3, rel=1e-2)


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80)]

    def text(bad):
        w = rng.choice(words, 60).tolist()
        for _ in range(6 * bad):
            w.insert(int(rng.integers(0, 60)), str(rng.choice(["vileword", "nastyone", "horridly"])))
        return " ".join(w)

    rows = [(i, text(i % 3 == 0)) for i in range(600)] + [(1000, None), (1001, ""), (1002, LONG), (None, text(False)), (5, text(False))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(0, 0), (None, 1), (700, None)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    out = toxicity.score(d, model).collect()
    assert len(out) == len(rows)
    held = [(r["predicted"], int(r["doc_id"] % 3 == 0)) for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean([p == y for p, y in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out) and {r["doc_id"]: r["predicted"] for r in out}[1001] == 0
    kept = toxicity.reject_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == sum(1 - r["predicted"] for r in out)
    assert toxicity.train(d, labels.limit(0)) is None and toxicity.score(d.limit(0), model).count() == 0
    assert {r["score"] for r in toxicity.score(d, None).collect()} == {0.0}


@pytest.mark.parametrize("ranges", [1, 4])
def test_fingerprints(spark, ranges):
    rows = [(i * 3, f"alpha{i} beta gamma{i % 2} delta epsilon " * (i + 1)) for i in range(9)] + [(40, None), (41, ""), (42, LONG), (42, "tie"), (43, "one two")]
    out = fingerprint.edited_fingerprints(docs(spark, rows), ranges=ranges).collect()
    order = sorted([(i, t or "") for i, t in rows])
    assert len(out) == len(rows)
    make = fingerprint.Fingerprints()
    got = {(r["doc_id"], r["n_chars"]): r for r in out}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i, len(t)]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["edited_fingerprint"] == fingerprint.spell(make.of(edited))
        assert r["fingerprint"] == fingerprint.spell(make.of(t)) and 0 <= r["near_edited"] <= 1 and r["near_next"] == fingerprint.likeness(make.of(t), make.of(nxt))
    assert fingerprint.edited_fingerprints(docs(spark, rows).limit(0)).count() == 0
    alone = fingerprint.edited_fingerprints(docs(spark, [(1, "a b c d")]), ranges=ranges).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_order_minhash_in_blocks_and_by_hand():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 50, 9000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k = fingerprint.shingles(w, fingerprint.K)
    seen, h = {}, []
    for x in k.tolist():
        h.append((x, seen.setdefault(x, 0)))
        seen[x] += 1
    numbered = fingerprint.numbered(k)
    assert len(set(numbered.tolist())) == len(h)
    want = []
    for odd in fingerprint._odd:
        with np.errstate(over="ignore"):
            v = numbered * odd
        a, b = sorted(np.argsort(v, kind="stable")[:2].tolist())
        want.append(int(fingerprint.mix(fingerprint.mix(k[a : a + 1]) * fingerprint.MULTIPLIERS[3] + k[b : b + 1] + odd)[0] >> np.uint64(32)))
    assert fingerprint.order_minhash(w).tolist() == want


def test_fingerprint_feels_order():
    make = fingerprint.Fingerprints()
    a = [f"w{i}" for i in range(400)]
    same = make.of(" ".join(a))
    assert fingerprint.likeness(same, make.of(" ".join(a))) == 1
    assert fingerprint.likeness(same, make.of(" ".join(a[:350] + ["new"] * 50))) > 0.6
    assert fingerprint.likeness(same, make.of(" ".join(a[200:] + a[:200]))) < 0.9
    assert fingerprint.likeness(same, make.of(" ".join(f"v{i}" for i in range(400)))) == 0


def test_units_of_text_without_blanks():
    make, rng = fingerprint.Fingerprints(), np.random.default_rng(3)
    text = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 3000))
    assert fingerprint.units("Ab " + text)[1:] == fingerprint.units(text) and b"".join(fingerprint.units(text)) == text.encode()
    same = make.of(text)
    assert fingerprint.likeness(same, make.of("x" + text)) > 0.9
    assert fingerprint.likeness(same, make.of(text[:1500] + "y" + text[1500:])) > 0.9
    assert fingerprint.likeness(same, make.of("".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 3000)))) == 0


def test_contamination(spark):
    item = "where the winding river meets the silent sea a lantern burns for those who dare to dream of distant shores and golden light"
    edited = item.replace("silent", "quiet").replace("dare", "wish").upper()
    rows = [*TEXTS, (20, f"intro words {item} and more"), (21, f"{edited}."), (22, "the winding road meets the sea of light for those who walk"), (23, "x " * 20_000 + item)]
    d = docs(spark, rows)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (1, item)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = {r["doc_id"]: r for r in decontaminate.find_contamination(d, items).collect()}
    assert set(out) == {20, 21, 23} and out[20]["score"] == 1 and 0.5 <= out[21]["score"] < 1 and out[20]["from_word"] == 2
    left = decontaminate.drop_contaminated(d, items)
    assert left.columns == d.columns and left.count() == len(rows) - 3
    assert decontaminate.find_contamination(d, items.limit(0)).count() == 0 and decontaminate.find_contamination(d.limit(0), items).count() == 0


def test_alignment_by_hand():
    rng = np.random.default_rng(2)
    items = [rng.integers(2, 6, int(n)).astype(np.uint64) for n in rng.integers(1, 9, 30)]
    passages = [rng.integers(2, 6, int(n)).astype(np.uint64) for n in rng.integers(1, 14, 30)]

    def one(a, b):
        h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
                h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
                best = max(best, h[i, j])
        return best

    assert decontaminate.align(items, passages)[0].tolist() == [one(a, b) for a, b in zip(items, passages)]


def test_warc(spark, tmp_path):
    page = "<html><head><title>A &amp; B</title><meta name='description' content='d'></head><body><p>One<script>x()</script></p><p>two  <b>bold</b></p><a href='/q?a=1&amp;b=2'>link</a></body></html>"
    rows = [(1, "http://a/", page), (2, None, None), (None, "http://b/", "<p"), (3, "u", "<p>" + "y " * 100_000), (1, "http://a/", page)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit(1)).withColumn("record_id", F.lit(2))
    out = warc.derivatives(p, with_member=True).collect()
    assert len(out) == 3 * len(rows) and warc.derivatives(p, with_response=False).count() == 2 * len(rows)
    ids = {r["record_id"] for r in out if r["record_type"] == "response"}
    assert all(r["refers_to"] in ids for r in out if r["record_type"] != "response")
    text = {r["page_id"]: r for r in out if r["record_type"] == "conversion"}
    meta = {r["page_id"]: json.loads(r["content"]) for r in out if r["record_type"] == "metadata"}
    assert text[1]["content"] == "One\ntwo bold\nlink" and text[2]["content"] == "" and text[None]["content"] == "<p"
    assert meta[1]["html"]["title"] == "A & B" and meta[1]["html"]["links"][0]["url"] == "/q?a=1&b=2"
    assert text[1]["refers_to"] == meta[1]["source"]["WARC-Record-ID"] and text[1]["payload_digest"] == warc.digest(page.encode())
    assert text[1]["block_digest"] == warc.digest(text[1]["content"].encode())
    (tmp_path / "a.warc.gz").write_bytes(b"".join(bytes(r["member"]) for r in out))
    back = warc.read_warc(spark, str(tmp_path / "a.warc.gz"))
    found = back.collect()
    assert len(found) == len(out) and not any(b["truncated"] for b in found)
    assert {f["value"] for b in found for f in b["fields"] if f["name"] == "WARC-Record-ID"} == {r["record_id"] for r in out}
    again = warc.derivatives_of_records(back).collect()  # from the responses read, the same as from the pages
    columns = ["record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest", "content"]
    assert sorted(str([r[c] for c in columns]) for r in again) == sorted(str([r[c] for c in columns]) for r in out if r["record_type"] != "response")
    assert warc.derivatives(p.limit(0)).count() == 0 and warc.derivatives_of_records(back.limit(0)).count() == 0


def test_warc_real_responses():
    """Headers as they came, repeated and continued; chunks, compression and charset undone for the text, digests of what was sent."""
    import gzip

    body = gzip.compress("<title>Ü</title><p>grün".encode("latin-1"))
    sent = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (body[:9], body[9:], b""))
    head = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n two\r\nContent-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2020-02-02T02:02:02Z", "WARC-Target-URI": "http://a/"}
    data = warc.record(fields, head + sent)
    [(got, block, truncated)] = warc.read_records(data)
    assert not truncated and block == head + sent
    (m, meta), (c, text) = warc.derive(dict(got), block)
    said = json.loads(meta)
    assert said["http"]["headers"][:3] == [["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"], ["X-Long", "one two"]]
    assert text.decode() == "grün" and said["html"]["title"] == "Ü" and c["WARC-Refers-To"] == "<urn:uuid:1>" and m["WARC-Date"] == "2020-02-02T02:02:02Z"
    assert c["WARC-Payload-Digest"] == warc.digest(sent)
    for cut in (3, len(data) - 10):
        both = [*warc.read_records(gzip.compress(data) + gzip.compress(data[:cut])), *warc.read_records(data + data[:cut])]
        assert [t for _, _, t in both] == [False, True] * 2 and both[0][1] == block
    assert list(warc.read_records(b"")) == []


@pytest.mark.parametrize("unit", ["<a ", "<title>", "<meta ", "<script>", "<!--", "</script ", '<a href="', "<a href='x\" ", "< ", "a=", "<svg>", "<head>x"])
def test_warc_long_pages_are_read_in_linear_time(unit):
    import time

    for tail in ("", ">"):
        page = unit * (1_000_000 // len(unit)) + tail
        began = time.process_time()
        warc.read_page(page)
        assert time.process_time() - began < 3


def test_warc_text_equals_a_plain_reading():
    """Against a reader that goes through the page a character at a time."""
    import random

    def plain(page):
        out, i, hidden = "", 0, None
        while i < len(page):
            if hidden:
                if page.startswith(f"</{hidden}>", i):
                    i, hidden = i + len(hidden) + 3, None
                else:
                    i += 1
            elif page[i] == "<":
                stop = page.index(">", i)
                tag, i = page[i + 1 : stop], stop + 1
                if tag in ("p", "/p", "script"):
                    out += "\n"
                hidden = "script" if tag == "script" else None
            else:
                out, i = out + page[i], i + 1
        return "\n".join(x for x in (" ".join(line.split()) for line in out.split("\n")) if x)

    rng = random.Random(5)
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "</p>", "<b>", "</b>", "word ", "  ", "<script>", "</script>", "x"]) for _ in range(30)) + "</script>"
        assert warc.read_page(page)[0] == plain(page)
