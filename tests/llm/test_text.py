import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, html_text, language, quality
from tidemark.llm.common import WordHasher, materialize

SF = "/root/testdata/sf0.01"


def test_words_hash_alike_wherever_they_stand():
    rng, plain, folded, seen = random.Random(3), WordHasher(), WordHasher(fold_case=True), {}
    for _ in range(1000):
        t = "".join(rng.choice(["a", "B", " ", "\n", "é", "word", "\x0b", "\x1c", " ", "Z "]) for _ in range(rng.randint(0, 20)))
        found, got = t.encode().split(), plain(t)
        assert len(found) == len(got) and all(seen.setdefault(w, h) == h for w, h in zip(found, got, strict=True))
        assert folded(t).tolist() == folded(t.encode().lower().decode()).tolist()
    assert len(set(seen.values())) == len(seen)


def plain_stats(t):
    w = (t or "").encode().split()
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics():
    rng, h = random.Random(4), WordHasher()
    for _ in range(1500):
        t = "".join(rng.choice(["a ", "b ", "c ", "\n", "# ", "é "]) for _ in range(rng.randint(0, 60)))
        assert quality.text_stats(t, h)[:5] == plain_stats(t)
    assert quality.text_stats(None, h) == quality.text_stats(" \n\t", h) == (0,) * 9


def test_quality_keeps_good_and_drops_bad(spark):
    from tidemark.llm.queries import op8_quality_rules

    got = op8_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("good")), "doc_id").where("not base_failed")
    good, bad = got.where("good = 1"), got.where("good = 0")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert bad.where("not kept").count() >= 0.9 * bad.count()


def test_quality_edges(spark):
    rng = random.Random(5)
    own = lambda end: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + end for _ in range(60))
    junk, prose = own("###"), own("")
    rows = [(k, prose, 1) for k in range(50)] + [(50 + k, junk + str(k), 1) for k in range(5)] + [(90, None, 1), (91, "", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, votes int")
    kept = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert kept == set(range(50))
    assert {r.doc_id for r in quality.keep_good(df).collect()} == kept and quality.keep_good(df).columns == df.columns
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_em_tells_two_groups_apart():
    good, bad = int("222222222", 3), int("220022222", 3)
    post = quality.fit({good: 900, bad: 100})
    assert post[good] > 0.9 > 0.5 > post[bad]
    assert quality.fit({}) == {}


def test_language_held_out_accuracy(spark):
    from tidemark.llm.queries import op2_language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op2_language_id(spark, SF).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "12 34!", None), (5, "und der", None)], "doc_id bigint, text string, lang string")
    profiles = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df, profiles).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "de"] and got[3].score == got[4].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.keep_known(df, profiles, 0.0)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 5} and kept.columns == df.columns
    assert language.fit(df.limit(0)).predict("the cat") == ("und", 0.0)


def test_chat_round_trip(spark):
    rng, rows = random.Random(6), []
    marks = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "<", "s>", "<<SYS>>", "<|end|>", "<|role|>", "é", "\n", "[", "INST]", "text"]
    for conv in range(40):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool<|text|>", None]), None if rng.random() < 0.1 else "".join(rng.choice(marks) for _ in range(rng.randint(0, 9)))))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = materialize(chat.format_turns(df), "t")
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    for conv in range(40):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        replies = "".join(t for r, t in own if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(own), len(replies))
        assert got[conv].loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
    every = chat.examples(turns).collect()
    ends = {c: r for c, _, r, _ in rows}
    assert len(every) == sum(r == "assistant" for _, _, r, _ in rows) + sum(r != "assistant" for r in ends.values()) == sum(r.n_examples for r in got.values())
    index = {(r.conv_id, r.example): r for r in chat.expand(turns).collect()}
    for conv in range(40):
        assert got[conv].formatted_chars == sum(len(e.context + e.target) for e in every if e.conv_id == conv)
    for e in every:
        row, whole = index.pop((e.conv_id, e.example)), e.context + e.target
        assert (row.context_chars, row.end_char) == (len(e.context), len(whole))
        own = [(r, t or "") for c, _, r, t in rows if c == e.conv_id]
        if row.loss_from is None:
            assert own[-1][0] != "assistant" and e.target == "" and e.context.count("[INST]") == sum(r == "user" for r, _ in own)
            continue
        assert chat.unescape(whole[row.loss_from : row.loss_to]) == chat.unescape(e.target[e.loss_from : e.loss_to])
        k = [i for i, (r, _) in enumerate(own) if r == "assistant"][e.example]
        assert chat.unescape(e.target[e.loss_from : e.loss_to]) == own[k][1]
        assert e.context.count("[INST]") == sum(r == "user" for r, _ in own[:k])
    assert not index
    wrong = chat.expand(turns).withColumn("end_char", F.col("end_char") + 1)
    with pytest.raises(Exception, match="does not end with its turns"):
        chat.digests(turns, wrong).collect()
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_language_equals_brute_force():
    """The out-of-place distance, n-gram by n-gram."""
    import pyarrow.parquet as pq

    def counted(text):
        chars, found = [0], Counter()
        for c in (text or "").lower():
            c = ord(c) if c.isalpha() else 0
            if c or chars[-1]:
                chars.append(c)
        if chars[-1]:
            chars.append(0)
        for i, c in enumerate(chars):
            found[c] += c > 0
            if i > 0:
                found[chars[i - 1] << 21 | c] += 1
            if i > 1 and chars[i - 1]:
                found[chars[i - 2] << 42 | chars[i - 1] << 21 | c] += 1
        return sorted((g for g in found if found[g]), key=lambda g: (-found[g], g))[: language.PROFILE] if len(chars) > 2 else []

    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    learned = {}
    for lang in sorted({r["lang"] for r in rows} - {None}):
        texts = "\n".join(r["text"] for r in rows if r["lang"] == lang and r["text"])
        learned[lang] = counted(texts)
    profiles = language.Profiles(learned)
    for text in [r["text"] for r in rows[:150]] + [None, "", "1 2", "É a", "der the"]:
        own = counted(text)
        if not own:
            assert profiles.predict(text) == ("und", 0.0)
            continue
        off = {lang: sum(min(abs(k - (p.index(g) if g in p else 10**9)), language.PROFILE) for k, g in enumerate(own)) for lang, p in learned.items()}
        best = min(sorted(off), key=off.get)
        got = profiles.predict(text)
        assert got[0] == best and got[1] == pytest.approx(1 - off[best] / (language.PROFILE * len(own)))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    from tidemark.llm import common

    text = "Ein Wort, noch eins. " * 300 + "x" * 400 + " 12 ΑΣ Σας"
    whole = [language.grams(text), WordHasher()(text), quality.text_stats(text, WordHasher())]
    for size in (1, 7, 100):
        monkeypatch.setattr(language, "PIECE_CHARS", size)
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        monkeypatch.setattr(quality, "PIECE_BYTES", size)
        again = [language.grams(text), WordHasher()(text), quality.text_stats(text, WordHasher())]
        assert all((a == b).all() for a, b in zip(whole[0], again[0], strict=True)) and (whole[1] == again[1]).all() and whole[2] == again[2]


def plain_votes(t):
    """Votes as a number, whether the base rule fails, and the five base statistics of one text."""
    w, (n, chars, symbols, dups, repeats) = (t or "").encode().split(), plain_stats(t)
    lines = sum(bool(x.encode().split()) for x in (t or "").split("\n"))
    letters, figures = sum(c.isascii() and c.isalpha() or c >= "À" for c in t or ""), sum("0" <= c <= "9" for c in t or "")
    at_least = lambda x: max(x, 1)
    measures = [n, chars / at_least(n), symbols / at_least(n), symbols / at_least(chars), dups / at_least(lines), repeats / at_least(n), letters / at_least(chars), figures / at_least(chars), len(set(w)) / at_least(n) ** 0.75]
    code = 0
    for m, (bad_below, good_from, good_to, bad_above) in zip(measures, quality.RULES.values(), strict=True):
        code = 3 * code + (0 if m < bad_below or m > bad_above else 2 if good_from <= m <= good_to else 1)
    return code, n < 10 or 100 * repeats > 20 * n, n, chars, symbols, dups, repeats


def plain_posterior(patterns):
    """EM pattern by pattern and rule by rule, with the prior beliefs that the module states."""
    from math import exp, log

    digits = lambda c: [c // 3**k % 3 for k in range(len(quality.RULES) - 1, -1, -1)]
    post = {c: 0.05 if 0 in digits(c) else 0.95 for c in patterns}
    for _ in range(60):
        total = sum(patterns.values())
        prior = min(max(sum(n * post[c] for c, n in patterns.items()) / total, 0.05), 0.95)
        share = {}
        for j in range(len(quality.RULES)):
            for good in (True, False):
                held = {v: sum(n * (post[c] if good else 1 - post[c]) for c, n in patterns.items() if digits(c)[j] == v) for v in (0, 2)}
                held[0], held[2] = held[0] + (0.2 if good else 2.0), held[2] + (2.0 if good else 0.2)
                share[j, good] = {v: held[v] / (held[0] + held[2]) for v in held}
        odds = {c: log((1 - prior) / prior) + sum(log(share[j, False][v]) - log(share[j, True][v]) for j, v in enumerate(digits(c)) if v != 1) for c in patterns}
        new = {c: 1 / (1 + exp(max(min(x, 60), -60))) for c, x in odds.items()}
        done = max(abs(new[c] - post[c]) for c in patterns) < 1e-9
        post = new
        if done:
            break
    return post


def test_quality_equals_brute_force(spark):
    """Statistics, base rule, votes, posterior and verdict of the whole table, one document at a time."""
    import pyarrow.parquet as pq

    from tidemark.llm.queries import op8_quality_rules

    rows = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = {r.doc_id: r for r in op8_quality_rules(spark, SF).collect()}
    code = {}
    for k, t in rows.items():
        code[k], failed, n, *others = plain_votes(t)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, *others, failed)
    post = plain_posterior(Counter(code.values()))
    for k, r in got.items():
        assert r.quality == pytest.approx(post[code[k]], abs=1e-6) and r.kept == (not r.base_failed and post[code[k]] >= quality.KEEP_FROM)


@pytest.fixture(scope="module")
def extractor():
    return html_text.Extractor(html_text.fit())  # the query's own model


def test_pages_exactly(extractor):
    import html
    import re

    import pyarrow.parquet as pq

    # whole pages of the largest table; pages 1006 and 1015 have tiny articles above long footers
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    for page, got in zip(pages, [x for k in range(0, len(pages), 250) for x in extractor(pages[k : k + 250])], strict=True):
        own = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        own = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", own))
        assert got == " ".join(html.unescape(own).split())


def test_composed_pages(extractor):
    rng, right, seen = random.Random(77), 0, 0
    for _ in range(150):
        page, main = html_text.compose(rng)
        got, want = Counter(extractor([page])[0].split()), Counter(main.split())
        right += sum((got & want).values()) * 2
        seen += sum(got.values()) + sum(want.values())
    assert right / seen > 0.95


def test_page_edges(extractor, spark):
    assert extractor(["", None, "<div", "<!-- x"]) == [""] * 4
    assert extractor(["1 &lt; 2 and 3 > 2 <b>x</b>y &amp;&nbsp;z"]) == ["1 < 2 and 3 > 2 xy & z"]
    page = "<article><h1>Title of it</h1><p>One <b>bold<p>Two, and three more words.<ul><li>four<li>five words of text.</ul></article><div class=comments><p>I like it, thanks.</p></div><footer>legal text</footer>"
    assert extractor([page])[0].startswith("Title of it One bold Two, and three more words.") and "thanks" not in extractor([page])[0]
    for deep in ("<div>" * 100_000 + "text of it" + "</div>" * 100_000, "<p><button>" + "<div>" * 50_000 + "x", "<svg>" * 50_000 + "x"):
        assert isinstance(extractor([deep])[0], str)
    df = spark.createDataFrame([(1, None, None), (1, "u", "")], "page_id bigint, url string, html string")
    model = extractor.model
    assert [r.n_chars for r in html_text.extract(df, model).collect()] == [0, 0]
    assert html_text.extract(df.limit(0), model).count() == 0


def test_abstentions_are_no_evidence():
    good, bad, unsure = int("222222222", 3), int("220022112", 3), int("222222112", 3)
    post = quality.fit({good: 900, bad: 100, unsure: 3})
    assert post[good] > 0.9 and post[unsure] > 0.9 and post[bad] < 0.5


@pytest.mark.parametrize("icon", ["<svg/>", "<math />", '<SVG class="i" width="9"/>', "<svg width=9/>hidden</svg>"])
def test_self_closed_svg_and_math(icon):
    page = f"<body><header>{icon}</header><p>article</p><svg><text>drawn</text></svg><math><mi>x</mi></math>end"
    got = " ".join(x for b in html_text.walk(html_text.parse(page)) for x in b.children if isinstance(x, str))
    assert got.split() == ["end", "article"]
