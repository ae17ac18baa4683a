"""Each operator against plain Python on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import codecs
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barline.llm import bpe, components, html_text, kernels, langid, media, mixing, near_dedup, quality, substring, token_files, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start int, rep long, label int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def table(spark, texts, ids=None, source=None):
    rows = [(i if ids is None else ids[i], t, "en", source[i] if source else "s", None if t is None else len(t), 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = [None, "", "  \n\t", "one", "One two", "...", "é 中文 😀", "x" * 30_000, "a b " * 4000, "\x00\x1f \x85\xa0"]


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain_components(texts, percent=85):
    sets, up = plain_sets(texts), list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    return sets, up


def test_near_duplicates_against_all_pairs(spark):
    base = [prose(s, 120) for s in range(12)]
    rng, texts = random.Random(5), list(ODD) + base
    for k in range(60):
        w = base[k % 4].split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(1000))
        texts.append(" ".join(w) if k % 5 else base[k % 4].upper())
    sets, want = plain_components(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_pipeline_links_from_four_fifths_up(spark):
    import corpus_pipeline

    texts = []
    for s in range(40):  # 196 shingles; two words changed far apart: 10 shingles gone of each, 186 of 206 alike; four: 176 of 216
        w = prose(500 + s, 200).split()
        texts += [" ".join(w), " ".join(f"new{i}" if i in (30, 80, 130, 180)[: 4 if s % 2 else 2] else x for i, x in enumerate(w))]
    _, up = plain_components(texts, 80)
    _, strict = plain_components(texts, 85)
    want = [i for i in range(80) if up[i] == i]
    assert len(want) == 40 < sum(strict[i] == i for i in range(80))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table(spark, texts), "").collect()) == want


@pytest.mark.parametrize("most, value", [("BLOCK", 8), ("BLOCK_SHINGLES", 1000)])
def test_large_buckets_are_dealt_out(spark, monkeypatch, most, value):
    monkeypatch.setattr(near_dedup, most, value)
    base = prose(1, 150).split()
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 140, 3)]
    _, want = plain_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    t = prose(3, 30)
    got = near_dedup.near_duplicates(table(spark, [t, t, t, None], [7, 7, None, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (-1, -1, True), (7, 7, True), (7, 7, True)]
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000), (2001, 2000), (2000, 2001), (None, 5)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 2000: 2000, 2001: 2000}


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
@pytest.mark.parametrize("top", [1, 2, 40, 1 << 16, (1 << 32) - 1])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32, endpoint=True)
    if n > 10:
        ids[::97] = (1 << 32) - 1
    area, start = token_files.pack_blocks(ids)
    assert np.array_equal(token_files.unpack_blocks(area, start, n), ids)
    names, ends, back = token_files.read_file(token_files.write_file([5, None], [ids, ids[:3]]))
    assert names == [5, None] and ends.tolist() == [n, n + len(ids[:3])] and np.array_equal(back[:n], ids)


def test_token_files(spark, monkeypatch, tmp_path):
    texts = [*ODD, "a   b  c ", " \n x", "<|endoftext|> it's", "a <|endoftext|>b  <|endoftext|>", *[prose(s, 20) for s in range(20)]]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in token_files.read(token_files.write(table(spark, texts), path, f"file://{tmp_path}/t", 2, 500)).collect()}
    plain = Tokenizer.from_file(path)
    at = 0
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(list((tmp_path / "t").iterdir())) > 3
    assert token_files.token_files(table(spark, []), path, 2).count() == 0


def test_bpe_against_the_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    odd = [*"ab é\n\t's0 \xa0\x1c中😀!?  ", "the", "ing", "\n\n", " \n "]
    texts = [*ODD[:-3], *["".join(rng.choices(odd, k=rng.randrange(30))) for _ in range(500)]]
    got = {r["doc_id"]: r for r in bpe.encode(table(spark, texts), path, public_tokenizers.PATTERN, True).collect()}
    for i, t in enumerate(texts):
        ids = np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[i]["ids"] == ids and got[i]["decoded"] == (t or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_transducer_against_merging():
    """A table of few letters, where every merge order matters."""
    rng = random.Random(0)
    for _ in range(20):
        parts = [bytes([c]) for c in b"abc"]
        while len(parts) < 14:
            new = rng.choice(parts) + rng.choice(parts)
            if new not in parts:
                parts.append(new)
        machine = bpe.Transducer({p: i for i, p in enumerate(parts)})
        for _ in range(200):
            piece = bytes(rng.choices(b"abc", k=rng.randrange(1, 16)))
            want = [machine.ranks[piece]] if piece in machine.ranks else [machine.ranks[p] for p in machine.merged(piece)]
            assert machine.encode(piece) == want


def test_utf8_machine_on_any_bytes():
    rng = random.Random(1)
    for _ in range(3000):
        data = bytes(rng.choices([0x41, 0xC3, 0xA9, 0xE0, 0xE2, 0x82, 0xAC, 0xED, 0xA0, 0xF0, 0x9F, 0x98, 0x80, 0xF4, 0x90, 0xFF, 0xC0], k=9))
        machine = bpe.Utf8Machine()
        said = "".join(machine.push(data[k : k + 2]) for k in range(0, 9, 2)) + machine.end()
        assert said == data.decode("utf-8", "replace") == codecs.decode(data, "utf-8", "replace")


def test_mixture_keeps_budgets(spark):
    texts = [prose(i, 10 + i % 7) for i in range(300)] + [None, ""]
    source = ["big" if i < 240 else "mid" if i < 290 else None for i in range(300)] + ["none", "none"]
    docs = table(spark, texts, None, source)
    size = {}
    for t, s in zip(texts, source):
        size[s] = size.get(s, 0) + (len(t or "") + 3) // 4
    got = mixing.mix(docs, repetition=3.0, share=1.0, block_tokens=200).collect()
    total = sum(size.values())
    sums = {}
    for r in got:
        sums[r["source"]] = sums.get(r["source"], 0) + (len(r["text"] or "") + 3) // 4
    assert total * 0.95 < sum(sums.values()) <= total
    assert sums[None] / size[None] <= 3.0 and sums[None] / size[None] > 2.5 and sums["big"] < size["big"]
    assert sum(r["source"] == "none" for r in got) == 2
    whole = mixing.mix(docs, repetition=2.0, block_tokens=200)
    assert whole.select("doc_id").distinct().count() == 302 and whole.columns == [*docs.columns, "epoch", "block", "place"]
    assert mixing.mix(table(spark, [])).count() == 0
    # each whole epoch of a source is a permutation of its blocks, and not the same one
    turns = {}
    for r in mixing.mix(docs, repetition=3.0, share=1.0, block_tokens=20).collect():
        if r["place"] is not None:
            turns.setdefault((r["source"], r["epoch"]), {})[r["place"]] = r["block"]
    full = [t for (s, e), t in turns.items() if s is None and e < 2]
    assert len(full) == 2 and full[0] != full[1] and len(full[0]) > 5 and sorted(full[0]) == sorted(full[1]) and sorted(full[0].values()) == sorted(full[1].values())


def test_mixing_beside_any_names(spark):
    docs = table(spark, [prose(i, 20) for i in range(60)] + ["x " * 300_000], None, ["a" if i % 3 else "b" for i in range(61)])
    own = "s b of id n key row at blocks whole room rest turns times e place_ _tokens _block _key s0 part tokens".split()
    wide = docs.select("*", *[F.lit(99).alias(c) for c in own])
    got, plain = mixing.mix(wide, share=1.0, block_tokens=500), mixing.mix(docs, share=1.0, block_tokens=500)
    assert got.columns == [*docs.columns, *own, "epoch", "block", "place"]
    assert got.where(" AND ".join(f"{c} = 99" for c in own)).count() == got.count()
    key = lambda df: sorted(map(tuple, df.select("doc_id", "epoch", "block", "place").collect()))
    assert key(got) == key(plain)
    assert mixing.mix(docs.withColumn("place", F.lit(1)), share=1.0).columns == [*docs.columns, "epoch", "block", "place"]


def test_many_sources_without_a_list(spark):
    sizes = spark.range(3000).selectExpr("concat('h', id) AS source", "1 + id * id % 997 AS tokens")
    w = mixing.weights(sizes, 4.0, None, 1.0).collect()
    total = sum(r["tokens"] for r in w)
    assert max(r["weight"] * total / r["tokens"] for r in w) == pytest.approx(4.0, abs=0.01) and sum(r["weight"] for r in w) == pytest.approx(1, abs=1e-4)


def test_entropy_target(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    w = [r["weight"] for r in mixing.weights(sizes, None, 0.9, 1.0).collect()]
    assert sum(w) == pytest.approx(1) and -sum(x * np.log(x) for x in w) / np.log(3) == pytest.approx(0.9, abs=1e-4)


def test_gradient_is_that_of_the_loss():
    p = {k: v.astype(np.float64) for k, v in langid.start(3, 1).items()}
    rng = np.random.default_rng(0)
    seq, lang = rng.integers(60, 140, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grad = langid.loss_and_gradient(p, seq, lang)
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape) if k[0] != "x" else (int(seq[0, 3]), int(rng.integers(0, p[k].shape[1])))
        for sign in (1, -1):
            p[k][at] += sign * 1e-5
            value = langid.loss_and_gradient(p, seq, lang)[0]
            up, down = (value, None) if sign == 1 else (up, value)
            p[k][at] -= sign * 1e-5
        assert grad[k][at] == pytest.approx((up - down) / 2e-5, abs=2e-4)


def test_languages(spark):
    rng = random.Random(0)
    kinds = {"aa": "tion ing the and with".split(), "bb": "sch ung für ich ö".split()}
    rows = [(i, " ".join(rng.choices(kinds[k], k=40)), k, "s", 1, 1, 1, 1) for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(100 + i, t, None, "s", 1, 1, 1, 1) for i, t in enumerate(ODD)]
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(rows, DOCS), steps=60).collect()}
    assert all(got[i]["lang_pred"] == r[2] for i, r in enumerate(rows[:80]))
    assert [got[100 + i]["lang_pred"] == "und" for i in range(len(ODD))] == [not any(c.isalpha() for c in t or "") for t in ODD]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[100]["score"] == 0
    assert {r["lang_pred"] for r in langid.language_id(table(spark, ["x y", None]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark):
    texts = [prose(i, 40) if i % 2 else " ".join(w + "###" for w in prose(i, 40).split()) for i in range(200)] + ODD
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == len(texts) and all(got[i]["predicted"] == i % 2 for i in range(200))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 for i in got)
    assert {r["score"] for r in quality.quality(docs, labels.where("false")).collect()} == {0.5}


def test_repeated_passages_go_and_the_first_stays(spark):
    passage = prose(99, 70)
    texts = [*ODD, *[prose(i, 50) + " " + (passage + " " if i % 3 == 0 else "") + prose(1000 + i, 40) for i in range(30)]]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in substring.substring_dedup(docs).collect()}
    holders = [i for i, t in enumerate(texts) if t and passage in t]
    core = " ".join(passage.split()[25:45])
    assert [i for i in holders if core in got[i]["text"]] == holders[:1]
    for i, t in enumerate(texts):
        if i not in holders[1:] and i not in (7, 8):  # these repeat themselves
            assert got[i]["text"] == t and got[i]["removed"] == []
        if t and i in holders:
            data, at, rest = t.encode(), 0, b""
            for r in got[i]["removed"]:
                rest, at = rest + data[at : r["start"]], r["stop"]
            assert (rest + data[at:]).decode() == got[i]["text"]
    assert substring.substring_dedup(docs).columns == [*docs.columns, "removed"]
    assert substring.substring_dedup(table(spark, [])).count() == 0


def test_repeated_rows_keep_what_the_first_keeps(spark):
    texts = {1: prose(1, 60), 2: prose(2, 60) + " " + prose(1, 60), 3: prose(3, 30) + " " + prose(4, 60) + " " + prose(4, 60)}
    rows = [(i, t) for i, t in texts.items()]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    once = {r["doc_id"]: (r["text"], r["removed"]) for r in substring.substring_dedup(make(rows)).collect()}
    assert once[1] == (texts[1], []) and len(once[2][0]) < 0.7 * len(texts[2]) and len(once[3][0]) < 0.8 * len(texts[3])
    for docs in (make(rows + rows), make(rows).union(make(rows)), make(rows + rows[1:]).union(make(rows[:1]))):
        got = substring.substring_dedup(docs).collect()
        assert len(got) == docs.count() and all((r["text"], r["removed"]) == once[r["doc_id"]] for r in got)


def test_repeated_passages_without_spaces_go(spark):
    rng = random.Random(7)
    write = lambda first, n: "".join(chr(first + rng.randrange(60)) for _ in range(n))
    for first in (0x4E00, 0x3041, 0x0E01, 0x20000):  # Chinese, Japanese, Thai, and characters of four bytes
        passages = [write(first, 100) for _ in range(20)]
        texts = [write(first, 150) + passages[i % 20] + write(first, 150) for i in range(40)]
        got = {r["doc_id"]: r["text"] for r in substring.substring_dedup(table(spark, texts)).collect()}
        assert all(got[i] == texts[i] for i in range(20))
        assert sum(len(got[i]) <= 400 - 30 for i in range(20, 40)) >= 18


def test_cuts_move_with_the_text():
    text = prose(5, 400).encode()
    part = lambda t: (lambda b: {t[x:y] for x, y in zip(b, [*b[1:], len(t)])})(substring.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)])).tolist())
    changed = part(text[:500] + b"inserted words " + text[500:])
    assert len(part(text) - changed) <= 4


def test_main_text():
    page = "<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><header>Site</header><div class='sidebar'>Side</div>"
    page += "<article><h1>Head &amp; line</h1><p>First  long <b>paragraph</b> of\nthe text, with words.<p>Second<br>one.<script>var a='</p>';</script></article>"
    page += "<section id=comments><p>A reader says something at length about all of this.</p></section><footer>&copy; end</footer>"
    assert html_text.main_text(page) == "Head & line\n\nFirst long paragraph of the text, with words.\n\nSecond one."
    assert html_text.main_text(None) == "" and html_text.main_text("<p></p><!-- x") == "" and html_text.main_text("just text") == "just text"
    assert html_text.main_text("<nav>open <p>but all the text is here, long enough to be seen.") != ""


def page_of(blocks, rng, kind):
    """A page whose article has these blocks, with all that does not belong to it; kind: the element round the article."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    body = "".join(rng.choice(["<p>%s</p>", "<p>%s", "<h2>%s</h2>", "<ul><li>%s</li></ul>", "<blockquote>%s</blockquote>"]) % esc(b).replace(" ", rng.choice([" ", "  ", "\n"]), 1) for b in blocks)
    body = f"{body[: len(body) // 2]}<!-- {prose(1, 30)} -->{body[len(body) // 2 :]}" if "<" not in body[len(body) // 2 - 8 : len(body) // 2 + 8] else body
    first, last = {"article": ("<article>", "</article>"), "main": ("<main><div class='post-body'>", "</div></main>"), "div": ("<div id=wrapper><div class=story>", "</div></div>")}[kind]
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in prose(2, 12).split())
    return (
        f"<!DOCTYPE html><html><head><title>{prose(3, 12)}</title><style>p{{}}</style><script>var a='</p>{prose(4, 40)}';</script></head><body class='has-sidebar'><nav><ul>{links}</ul></nav>"
        f"<div class='cookie-banner'><p>{prose(5, 25)}</p></div><header><p>{prose(6, 8)}</p></header>{first}{body}{last}<aside><p>{prose(7, 30)}</p></aside><div class='ad-slot'>{prose(8, 30)}</div>"
        f"<form><label>{prose(9, 10)}</label><textarea>{prose(9, 30)}</textarea></form><section id=comments><p>{prose(10, 90)}</p><p>{prose(11, 60)}</p></section><footer><p>{prose(12, 20)}</p></footer></body></html>"
    )


def test_pages_give_their_articles(spark):
    rng, rows, want = random.Random(1), [], {}
    for i in range(60):
        blocks = ["Title & more", *[prose(100 + i * 20 + k, rng.choice([2, 15, 40, 60])) for k in range(rng.randrange(4, 9))], prose(i, 50), "Short end."]
        rows.append((i, "u", page_of(blocks, rng, ("article", "main", "div")[i % 3]), 7, "x"))
        want[i] = "\n\n".join(blocks)
    rows += [(100, None, None, 7, "x"), (101, "u", "", 7, "x"), (102, "u", "words alone", 7, "x"), (None, "u", "<p>a &amp; b", 7, "x"), (103, "u", "<div>" * 50_000 + "deep", 7, "x"), (0, "u", rows[0][2], 7, "x")]
    want |= {100: "", 101: "", 102: "words alone", None: "a & b", 103: "deep"}
    make = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html_text.extract(make(rows).repartition(3)).collect()
    assert len(got) == len(rows) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(make([])).count() == 0


@pytest.mark.parametrize("mark", ["id='social-history'", "class='form-factor'", "class='side-effects'", "id='search-algorithms'", "title='a hidden gem'"])
def test_words_that_only_look_like_marks(mark):
    page = f"<nav>menu</nav><article><h1>Title</h1><p>Some words of text are here to be read.</p><p {mark}>These as well.</p><p hidden>not these</p></article>"
    assert html_text.main_text(page) == "Title\n\nSome words of text are here to be read.\n\nThese as well."


def test_text_is_what_lies_between_surge_and_dive(monkeypatch):
    weights = [0, 5, 60, 80, 3, 50, 0, 0, 0, 2, 45, 90, 0]
    assert html_text.regions(weights, 40) == [(2, 5), (10, 11)]  # windows of three lines; light lines at either end go
    assert html_text.regions(weights, 140) == [(2, 3)] and html_text.regions(weights, 1000) == []
    page = "<body>" + "".join(f"<p>{prose(k, n)}</p>" for k, n in enumerate((1, 30, 40, 30, 1)))
    whole = html_text.main_text(page)
    monkeypatch.setattr(html_text, "LEVEL", 10**6)
    assert html_text.main_text(page) != whole


def test_top_k_with_ties(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(v) for v in np.round(rng.normal(0, 0.02, 6), 2)], 1) for i in range(120)]
    vectors += [(200, None, 1), (201, [float("nan")] * 6, 1), (202, [None] * 6, 1), (250, [], 1), (None, [1.0], 1)]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank int").repartition(3), F.col("vec_id") % 50 == 0).collect()
    sound = {i: np.floor(256 * np.array(np.array(v, np.float32), float)).astype(int) for i, v, _ in vectors[:120]} | {250: np.zeros(0, int)}
    for q in (0, 50, 100, 250):
        score = lambda i: int((sound[q][: min(len(sound[q]), len(sound[i]))] * sound[i][: min(len(sound[q]), len(sound[i]))]).sum())  # noqa: B023, E731
        want = sorted((-score(i), i) for i in sound if i != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_image_copies(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, [float(v) for v in rng.normal(0, 1, 64)]) for i in range(20)], "vec_id long, embedding array<double>")
    rows = [(r["image_id"], r["width"], r["height"], bytes(r["pixels"])) for r in media.render(vectors).collect()]
    pictures = {i: np.frombuffer(p, np.uint8).reshape(h, w) for i, w, h, p in rows}
    edits = [pictures[0][8:90, 6:92], np.clip(pictures[1].astype(int) + 25, 0, 255).astype(np.uint8), np.rot90(pictures[2]), pictures[3]]
    rows += [(100 + k, e.shape[1], e.shape[0], np.ascontiguousarray(e).tobytes()) for k, e in enumerate(edits)]
    rows += [(200, 4, 4, bytes(16)), (201, None, 4, None), (202, 5, 5, b"short"), (None, 4, 4, bytes(16))]
    got = {r["image_id"]: r["component_id"] for r in media.copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()}
    assert got == {**{i: i for i in range(20)}, 100: 0, 101: 1, 102: 2, 103: 3, 200: 200, 201: 201, 202: 202, None: None}


def test_held_out_languages_and_qualities(spark):
    """On rows that nothing was learned from, with the defaults of the queries."""
    from barline.llm import queries

    folder = "/root/testdata/sf0.01"
    docs, labels = ({r["doc_id"]: r for r in spark.read.parquet(f"{folder}/{t}.parquet").collect()} for t in ("documents", "labels"))
    told = [r for r in queries.op4_language_id(spark, folder).collect() if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert len(told) > 100 and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in told) >= 0.97 * len(told)
    scored = [(r["score"], labels[r["doc_id"]]["quality"], r["predicted"]) for r in queries.op9_quality(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y, _ in scored if y == 1], [s for s, y, _ in scored if y == 0]
    assert good and bad and sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(p == y for _, y, p in scored) >= 0.85 * len(scored)


def test_classifiers_on_repeats_clashes_and_nothing(spark):
    texts = [prose(i, 30) for i in range(40)]
    docs = table(spark, texts + texts[:5], [*range(40), *range(5)]).withColumn("score", F.lit(9)).withColumn("lang_pred", F.lit("own")).withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    told = langid.language_id(docs, steps=5)
    assert told.count() == 45 and told.where("lang_pred = 'own' OR score = 9").count() == 0 and langid.language_id(docs.where("false"), steps=5).count() == 0
    got = quality.quality(docs, labels).collect()
    assert len(got) == 45 and all(len({r["score"] for r in got if r["doc_id"] == i}) == 1 for i in range(5))
    assert quality.quality(docs.where("false"), labels).count() == 0 and {r["score"] for r in quality.quality(docs, labels.where("false")).collect()} == {0.5}


def test_removed_spans_against_a_plain_version(spark):
    """Every chunk of every document in the order of ids, by one dictionary."""
    rng = random.Random(12)
    parts = [prose(700 + k, rng.randrange(5, 60)) for k in range(12)]
    texts = [" ".join(rng.choice([rng.choice(parts), prose(2000 + i * 7 + k, 20)]) for k in range(rng.randrange(1, 7))) for i in range(80)] + [None, "", parts[0] * 40]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        data, runs = (t or "").encode(), []
        starts = substring.cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)])).tolist()
        for x, y in zip(starts, [*starts[1:], len(data)]):
            if data[x:y] in seen:
                runs = [*runs[:-1], [runs[-1][0], y]] if runs and runs[-1][1] == x else [*runs, [x, y]]
            seen.add(data[x:y])
        want[i] = [(x, y) for x, y in runs if y - x >= substring.LEAST_RUN]
    got = {r["doc_id"]: [(x["start"], x["stop"]) for x in r["removed"]] for r in substring.substring_dedup(table(spark, texts)).collect()}
    assert got == want and sum(map(bool, want.values())) > 20


def resized(p, f):
    """By bilinear sampling, after a blur if smaller."""
    x = media._blur(p.astype(float)) if f < 1 else p.astype(float)
    ys, xs = ((np.arange(int(n * f)) + 0.5) / f - 0.5 for n in p.shape)
    y, x0 = np.clip(ys.astype(int), 0, p.shape[0] - 2), np.clip(xs.astype(int), 0, p.shape[1] - 2)
    fy, fx = np.clip(ys - y, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None]
    told = (x[y][:, x0] * (1 - fx) + x[y][:, x0 + 1] * fx) * (1 - fy) + (x[y + 1][:, x0] * (1 - fx) + x[y + 1][:, x0 + 1] * fx) * fy
    return np.rint(told).clip(0, 255).astype(np.uint8)


def test_recall_of_edited_copies_among_pictures_with_common_corners(spark):
    """Drawn pictures share the descriptors of plain corners; each of ten edits of 12 of them, one copy a picture and edit."""
    rng = np.random.default_rng(11)
    vectors = spark.createDataFrame([(i, [float(v) for v in rng.normal(0, 1, 64)]) for i in range(130)], "vec_id long, embedding array<double>")
    rows = [(r["image_id"], r["width"], r["height"], bytes(r["pixels"])) for r in media.render(vectors).collect()]
    pictures = {i: np.frombuffer(p, np.uint8).reshape(h, w) for i, w, h, p in rows}
    clip = lambda x: np.clip(x, 0, 255).astype(np.uint8)
    edits = [
        lambda p: p[10:87, 9:86], lambda p: p[19:77, 19:77], lambda p: p[:60, :60], lambda p: clip(p.astype(int) + 25), lambda p: clip(p * 0.7 + 20), np.rot90,
        lambda p: clip(np.rint(p + rng.normal(0, 6, p.shape))), lambda p: resized(p, 0.75), lambda p: resized(p, 0.5), lambda p: resized(p, 1.5),
    ]
    want = {}
    for k, edit in enumerate(edits):
        for i in range(12):
            at = 1000 * (k + 1) + 12 * k + i
            e = np.ascontiguousarray(edit(pictures[12 * k + i]))
            rows.append((at, e.shape[1], e.shape[0], e.tobytes()))
            want[at] = 12 * k + i
    got = {r["image_id"]: r["component_id"] for r in media.copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary").repartition(4)).collect()}
    assert all(got[i] == i for i in range(130))
    assert sum(got[a] == i for a, i in want.items()) >= 0.95 * len(want)
    for k in range(len(edits)):
        assert sum(got[a] == want[a] for a in want if a // 1000 == k + 1) >= 0.9 * 12, k


def test_crowded_entries_lose_no_copy(spark, monkeypatch):
    """A group of copies far over CROWD, and pairs that share every crowded word of the level before with many others."""
    monkeypatch.setattr(media, "CROWD", 3)
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, [float(v) for v in rng.normal(0, 1, 64)]) for i in range(40)], "vec_id long, embedding array<double>")
    rows = [(r["image_id"], r["width"], r["height"], bytes(r["pixels"])) for r in media.render(vectors).collect()]
    one = np.frombuffer(rows[7][3], np.uint8).reshape(96, 96)
    for k in range(60):
        e = np.ascontiguousarray(one[k % 4 : 96 - k % 3, : 96 - k % 5]) if k % 2 else np.clip(one.astype(int) + k // 2 - 15, 0, 255).astype(np.uint8)
        rows.append((500 + k, e.shape[1], e.shape[0], e.tobytes()))
    images = spark.createDataFrame([(*r, 1, "x") for r in rows + rows[:2]], "image_id long, width int, height int, pixels binary, a int, word string")
    got = media.copies(images).collect()
    assert len(got) == len(rows) + 2
    assert {(r["image_id"], r["component_id"]) for r in got} == {(i, i if i < 500 else rows[7][0]) for i, *_ in rows}
    assert media.copies(images.where("false")).count() == 0


def test_meeting_is_that_of_plain_entries(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(media, "CROWD", 4)
    rng = random.Random(3)
    rows = sorted({(rng.choice([1, 2, 3, 4, 5, 9, 9, 9, 9, 9]), rng.randrange(60)) for _ in range(90)})
    for step in (1, 3, 7, 1000):
        batches = [pa.record_batch({"word": [w for w, _ in rows[k : k + step]], "image_id": [i for _, i in rows[k : k + step]], "m": [0] * len(rows[k : k + step])}) for k in range(0, len(rows), step)]
        for last in (False, True):
            out = [r for b in media._meet(last)(iter(batches)) for r in b.to_pylist()]
            for w in {w for w, _ in rows}:
                mine = [i for x, i in rows if x == w]
                pairs = {(r["a"], r["b"]) for r in out if r["word"] == w and r["a"] is not None}
                if len(mine) <= 4:
                    assert pairs == {(a, b) for a in mine for b in mine if a < b}
                elif last:
                    assert pairs >= set(zip(mine, mine[1:])) | {(mine[0], b) for b in mine[1:]}
                else:
                    assert any(r["word"] == w and r["a"] is None for r in out)


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    langs = {"aa": "tion ing the and with".split(), "bb": "sch ung für ich ö".split()}
    rng, texts, names = random.Random(4), [], []
    for i in range(60):
        k = "aa" if i % 2 else "bb"
        texts.append(" ".join(rng.choice(langs[k]) + rng.choice(langs[k]) + rng.choice(langs[k]) for _ in range(60)))
        names.append(k)
    texts += [texts[0], None, "12 34"]
    names += ["bb", "aa", "aa"]
    rows = [(i, t, n, "s%d" % (i % 3), len(t or ""), 1, 1, 1) for i, (t, n) in enumerate(zip(texts, names))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(range(60)) and [n for n, _ in corpus_pipeline.STAGES][0] == "language ID"
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(plain.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()).hexdigest() for r in got)


def test_stages_on_odd_tables(spark):
    import corpus_pipeline

    rng = random.Random(8)
    langs = {"aa": "tion ing the and with".split(), "bb": "sch ung für ich ö".split()}
    write = lambda k, n=60: " ".join("".join(rng.choices(langs[k], k=3)) for _ in range(n))
    rows = [(i, write(k), k, "s%d" % (i % 3), 1, 1, 1, 1) for i, k in enumerate(["aa", "bb"] * 30)]
    rows += [rows[0], rows[0], (5, write("aa"), "aa", None, 1, 1, 1, 1), (None, write("bb"), "bb", "s1", 1, 1, 1, 1), (90, None, "aa", "s1", 1, 1, 1, 1), (91, "12 34", None, "s1", 1, 1, 1, 1), (92, "", None, None, 1, 1, 1, 1)]
    rows += [(200, rows[1][1] + " " + write("bb", 3), "bb", "s2", 1, 1, 1, 1), (201, rows[2][1], None, "s2", 1, 1, 1, 1), (202, write("aa", 20_000), "aa", "s2", 1, 1, 1, 1)]
    clash = "block place epoch spans removed kept rep key row lang_pred score _at".split()
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(7).alias(c) for c in clash if c != "rep"])
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, "")
        assert stage(spark, empty, "").count() == 0, name
        if stage is not corpus_pipeline.tokens:
            assert left.columns == docs.columns, name
            left = left.cache()
            assert left.where(" AND ".join(f"{c} = 7" for c in clash if c != "rep")).count() == left.count()
        ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in left.select("doc_id").collect())
        everyone = sorted(-1 if r[0] is None else r[0] for r in rows)
        if stage is corpus_pipeline.language:
            assert ids == [i for i in everyone if i not in (90, 91, 92)]
        elif stage is corpus_pipeline.near_duplicates:  # 0 stays once, 5 names two texts, 200 and 201 are near copies
            assert ids == sorted([-1, *range(60), 5, 90, 91, 92, 202])
        elif stage is corpus_pipeline.substrings:
            assert set(ids) >= {-1, *range(60), 90}
        elif stage is corpus_pipeline.mixture:
            assert set(ids) == set(everyone)
        else:
            assert ids == everyone
