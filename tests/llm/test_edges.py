"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for the operators on documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from relish.llm import lattice, lm, nearest, packing, preferences, substring, topk, toxicity, url_filter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TOKENIZER, RANKS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def split(text):
    return WORD.findall((text or "").encode())


def odd_rows():
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 90))]
        if i % 4 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(20):rng.randrange(30, 60)]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, rows[4][1]), (64, rows[4][1]), (64, rows[4][1]), (None, rows[8][1]), (None, None),
             (65, "é ñ\x0bß x 漢字 \U0001f600 " * 30), (66, "word " * 20_000), (67, "x" * 70_000), (68, "A b" + " \r\n" + "C<|endoftext|> d")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 5, [1.0]) for i, t in odd_rows()],
                                 "doc_id long, text string, block string, score int, repeats array<double>").repartition(4).cache()


def empty(docs):
    return docs.filter("false")


def key(row):
    return tuple((x is None, 0 if x is None else x) for x in row)


def test_substring_removal(spark, docs):
    got = sorted([(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest(), len(r["text"] or ""))
                  for r in substring.remove_repeats(docs).collect()], key=key)
    for r in substring.remove_repeats(docs).filter("doc_id = 63").collect():
        assert [tuple(s) for s in r["repeats"]] == ([(0, r["n_words"])] if r["n_words"] >= 20 else [])
    rows = [r for r in odd_rows() if r[0] not in (None, 64)]  # ids that are single
    single = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen, want = set(), []
    for row_id, text in sorted(rows):
        words = split(text)
        gone = set()
        for s in range(len(words) - 19):
            if (run := tuple(words[s:s + 20])) in seen:
                gone.update(range(s, s + 20))
            seen.add(run)
        want.append((row_id, len(words), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()))
    assert sorted(tuple(r) for r in substring.remove_repeats(single).select("doc_id", "n_words", "n_removed", "kept_text").rdd.map(
        lambda r: (r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest())).collect()) == want
    assert len(got) == len(odd_rows()) and [r[2] for r in got if r[0] == 64][1:] == [r[1] if r[1] >= 20 else 0 for r in got if r[0] == 64][1:]
    assert substring.remove_repeats(empty(docs)).count() == 0


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, TOKENIZER, RANKS).collect()
    by_doc = {}
    for r in rows:
        assert r["length"] == 1 << r["bucket"] <= 1024 and len(r["ids"]) == 4 * r["length"] and r["offset"] == 0
        by_doc.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    tool = Tokenizer.from_file(TOKENIZER)
    for row_id, text in odd_rows():
        if row_id in (None, 64):
            continue
        want = tool.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[row_id])
        assert sum((p[1] for p in pieces), []) == want and {p[2] for p in pieces} == {len(want)}
        assert [p[0] for p in pieces] == np.cumsum([0] + [len(p[1]) for p in pieces])[:-1].tolist()
    assert sorted((r["doc_id"] is None, r["length"], zlib.crc32(r["ids"])) for r in packing.pack(docs, TOKENIZER).collect()) == sorted(
        (r["doc_id"] is None, r["length"], zlib.crc32(r["ids"])) for r in rows)
    assert packing.pack(empty(docs), TOKENIZER).count() == 0


def test_toxicity(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "river", "runs", "slowly", "past", "houses"]) for _ in range(40)) + (" vile scum" if i % 3 == 0 else ""), i % 3 == 0)
            for i in range(300)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad)) for i, _, bad in rows] + [(1, None), (5, 7), (None, 1), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit_labels(texts, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(texts, model).collect()}
    assert all((scored[i] >= 0.5) == bad for i, _, bad in rows)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd) and len({r["score"] for r in odd if not r["text"]}) == 1
    assert len({r["score"] for r in odd if r["doc_id"] == 64}) == 1
    assert toxicity.score(empty(docs), model).count() == 0
    for few in (labels.filter("false"), labels.filter("toxic = 1")):
        assert {0.5 <= r["score"] < 1 for r in toxicity.score(texts, toxicity.fit_labels(texts, few)).collect()} == {True}
    long = max(odd, key=lambda r: len(r["text"] or ""))["text"]
    assert toxicity.text_scores([long, "", "vile scum"], model).tolist() == [toxicity.text_scores([t], model)[0] for t in (long, "", "vile scum")]


def test_lattice_sums_all_spellings():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b"ba", b" ab", b"abb"]
    log_p = np.log(np.arange(1, 9) / 36)

    def total(rest):
        return 1.0 if not rest else sum(math.exp(log_p[i]) * total(rest[len(p):]) for i, p in enumerate(pieces) if rest.startswith(p))

    words = np.frombuffer(b" abbab babba", np.uint8).reshape(2, 6)
    tool = lattice.Automaton(pieces)
    assert np.allclose(np.exp(lattice.forward(words, tool, log_p)), [total(b" abbab"), total(b" babba")])
    counts = lattice.expected(words, np.array([1.0, 2.0]), tool, log_p)
    step = 1e-6  # expected counts are the slopes of the log probability in the log weights
    for i in range(len(pieces)):
        moved = log_p.copy()
        moved[i] += step
        slope = (lattice.forward(words, tool, moved) - lattice.forward(words, tool, log_p)) / step
        assert counts[i] == pytest.approx(slope @ [1.0, 2.0], abs=1e-4)


def test_language_model_scores(docs):
    tokens = [(i, [w.lower() for w in split(t)] + [None]) for i, t in odd_rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    train = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(train.values()), len(train)
    got = lm.score(docs, PIECES, rounds=1).collect()
    want = sorted([(i, held(i), len(ws), sum(train[w] > 0 for w in ws), n, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4))
                   for i, ws in tokens], key=key)
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got], key=key) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got) and len({r["score"] for r in got if r["doc_id"] == 64}) == 1
    assert lm.score(empty(docs), PIECES).count() == 0


def test_search_finds_what_all_scores_say(docs):
    rows = [(i, t) for i, t in odd_rows() if i is not None]
    bags = [Counter(w.lower() for w in split(t)) for _, t in rows]
    df = Counter(w for bag in bags for w in bag)
    mean = sum(sum(b.values()) for b in bags) / len(rows)

    def part(word, bag):
        return math.log(1 + (len(rows) - df[word] + 0.5) / (df[word] + 0.5)) * bag[word] * 2.2 / (bag[word] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))

    got = {}
    for r in topk.search(docs, lambda i: i % 7 == 0, k=5, terms=10_000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for n, (row_id, _) in enumerate(rows):
        if row_id % 7 == 0 and row_id != 63:
            words = [w for w in bags[n] if df[w] > 1]
            scores = sorted(((-round(sum(part(w, bag) for w in words if w in bag), 9), i) for m, ((i, _), bag) in enumerate(zip(rows, bags))
                             if m != n and any(w in bag for w in words)))[:5]
            mine = sorted(got.get(row_id, []))
            assert [m[1] for m in mine] == [i for _, i in scores] and np.allclose([m[2] for m in mine], [-s for s, _ in scores])
    assert topk.search(empty(docs), lambda i: i % 7 == 0).count() == 0


def test_wand_equals_full_scoring():
    rng = random.Random(4)
    for trial in range(60):
        lists = []
        for _ in range(rng.randrange(1, 7)):
            documents = sorted(rng.sample(range(3000), rng.randrange(1, 900)))
            scores = [rng.choice([0.5, 1.0, 2.0, rng.random()]) for _ in documents]
            lists.append((documents, scores, [max(scores[i:i + topk.POSTINGS]) for i in range(0, len(scores), topk.POSTINGS)]))
        total = {}
        for documents, scores, _ in lists:
            for d, s in zip(documents, scores):
                total[d] = total.get(d, 0.0) + s
        skip = rng.choice(sorted(total))
        want = sorted(((s, d) for d, s in total.items() if d != skip), key=lambda x: (-x[0], x[1]))[:10]
        assert topk.wand(lists, 10, skip) == want


def test_nearest_on_odd_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(16) * rng.choice([0.1, 1, 30])).tolist(), "v") for i in range(400)]
    rows += [(400 + i, rows[3][1], "same") for i in range(40)] + [(i, bad, "x") for i, bad in enumerate(
        [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0], []], 500)] + [(None, rows[0][1], "n")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string").repartition(3)
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and i < 500]
    got = {}
    for r in nearest.search(table, lambda i: i % 10 == 0, k=20, block=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, v in good:
        if q % 10 == 0:
            want = [i for _, i in sorted((-float((v * w).sum()), i) for i, w in good if i != q)[:20]]
            mine = sorted(got[q])
            assert [m[0] for m in mine] == list(range(1, 21)) and q not in [m[1] for m in mine]
            assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
            hits, total = hits + len(set(want) & {m[1] for m in mine}), total + 20
    assert hits >= 0.95 * total
    assert nearest.search(table.filter("false"), lambda i: i % 10 == 0).count() == 0
    two = nearest.search(table.filter("vec_id < 2 and block = 'v'"), lambda i: i == 0, k=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(0, 1, 1)]
    assert nearest.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.5])], "vec_id long, embedding array<double>"), lambda i: i == 0).count() == 2


@pytest.mark.parametrize("segment_bits", [1 << 25, 256])
def test_url_filter(spark, segment_bits):
    urls = [None, "", "no scheme", "://", "http://A.Example.NET/en/x?y#z", "http://example.net/en", "http://example.net/en/", "http://xexample.net/en/",
            "http://b.example.com/de/1", "http://example.com/DE/1", "http://c.org/fr/", "http://c.org?/fr/", "http://listed.io/a", "http://listed.io/a?b", "http://free.io/a/b",
            "ftp://listed.io/a\nb", "http://" + "d." * 200 + "net/" + "e" * 5000] + [f"http://h{i % 40}.io/p{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(5, urls[5], "x", 1)], "page_id long, url string, host string, segment int").repartition(3)
    listed = {("listed.io", "/a")} | {(f"h{i % 40}.io", f"/p{i}") for i in range(0, 300, 3)}
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    got = url_filter.judge(pages, rules, spark.createDataFrame(sorted(listed), "host string, path string"), segment_bits=segment_bits).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        url = r["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(rule), rule, verdict) for verdict, rule in rules
                if (host == rule[:rule.index("/")] or host.endswith("." + rule[:rule.index("/")])) and path.startswith(rule[rule.index("/"):])]
        rule = max(fits)[1] if fits else None
        verdict = max(fits)[2] if fits else "block" if (host, path) in listed else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
    assert url_filter.judge(pages.filter("false"), rules, spark.createDataFrame([], "host string, path string")).count() == 0


def test_preference_pairs(spark):
    t = lambda *turns: [{"role": r, "text": x} for r, x in turns]
    rows = [
        (1, t(("user", "a"), ("assistant", "b"), ("user", "c")), t(("user", "a"), ("assistant", "d"))),
        (2, t(("user", "a")), t(("user", "a"))), (3, None, t(("assistant", "x"))), (4, [], None),
        (5, t((None, None), ("assistant", None)), t((None, None), ("assistant", ""))), (5, t((None, None), ("assistant", None)), t((None, None), ("assistant", ""))),
        (6, t(("user", "w " * 50_000), ("assistant", "ok")), t(("user", "w " * 50_000), ("assistant", "no"))),
    ]
    pairs = spark.createDataFrame([(*r, "p") for r in rows], "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    for r in preferences.format_pairs(pairs).collect():
        a, b = r["chosen"] or [], r["rejected"] or []
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if tuple(x) != tuple(y)), min(len(a), len(b)))
        draw = lambda turns: "".join(f"<|{x['role'] or ''}|>\n{x['text'] or ''}<|end|>\n" for x in turns)
        assert (r["n_common"], r["prompt"], r["chosen_text"], r["rejected_text"]) == (n, draw(a[:n]), draw(a[n:]), draw(b[n:]))
        for turns, text, spans in ((a[n:], r["chosen_text"], r["chosen_spans"]), (b[n:], r["rejected_text"], r["rejected_spans"])):
            assert [text[s["start"]:s["end"]] for s in spans] == [f"{x['text'] or ''}<|end|>\n" for x in turns if x["role"] == "assistant"]
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 1, "assistant", "r"), (2, 0, None, None), (None, 0, "user", "x"), (3, None, "assistant", "z")],
                                  "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in preferences.format_pairs(preferences.reply_pairs(turns)).collect()}
    assert set(got) == {1, 2, None, 3} and got[1]["n_common"] == 3 and got[3]["rejected_text"] == "<|assistant|>\n<|end|>\n"
    assert preferences.format_pairs(preferences.reply_pairs(turns.filter("false"))).count() == 0
