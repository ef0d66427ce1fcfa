"""Problems 2, 4, 6, 7 and 9 on small cases."""

import random
import re
from collections import defaultdict

import pytest

from newsloom.llm import languages as lg
from newsloom.llm import main_content as mc
from newsloom.llm import mixture as mx
from newsloom.llm import repeated_lines as rl
from newsloom.llm import truncation as tr

LEGAL = "© 2024 The Paper. All rights reserved."


def site(spark):
    rows = [(i, "a", f"Title line {chr(97 + i)}\n<p>{LEGAL.replace('2024', str(2000 + i))}</p>\nShare\n\nend {chr(97 + i)} {chr(98 + i)}", "x") for i in range(8)]
    rows += [(20, "b", LEGAL, "x"), (21, None, LEGAL, "x"), (22, "a", None, "x"), (23, "a", "", "x"), (24, "a", "Share\nShare\n" + "word " * 50_000, "x"), (None, "a", LEGAL, "x")]
    return spark.createDataFrame(rows, "id long, source string, content string, key string"), rows


def test_repeated_lines(spark):
    df, rows = site(spark)
    seen = defaultdict(set)
    at = defaultdict(list)
    for i, s, c, _ in rows:
        for n, line in enumerate((c or "").split("\n"), 1):
            key = " ".join(re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", "", line))).lower()
            if key and s is not None and i is not None:
                seen[s, key].add(i)
                at[s, key].append((i, n))
    want = sorted(x for k, v in seen.items() if len(v) >= 6 for x in at[k])
    assert sorted((r.id, r.line_no) for r in rl.repeated_lines(df).collect()) == want and (24, 2) in want
    clean = {r.id: r for r in rl.without_repeated_lines(df).collect()}
    assert clean[0].content == "Title line a\n\nend a b" and clean[0].removed == 2
    assert clean[20].content == LEGAL and clean[22].content is None and clean[23].content == ""
    assert rl.repeated_lines(df.limit(0)).count() == 0


def test_frequent_sequences(spark):
    df, _ = site(spark)
    found = rl.frequent_sequences(df).collect()
    assert sorted((r.length, r.support) for r in found) == [(1, 8), (1, 9), (2, 8)]
    assert rl.frequent_sequences(df.limit(0)).count() == 0


@pytest.mark.parametrize(("gap", "length"), [(1, 2), (2, 3), (3, 4)])
def test_prefix_span_equals_brute_force(spark, gap, length):
    rng = random.Random(gap)
    names = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(i, rng.choice("xxy"), "\n".join(rng.choice([*names, f"own{i}"]) for _ in range(rng.randrange(9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, source string, content string")
    held = defaultdict(set)
    for i, s, c in rows:
        for w in set(c.split("\n")) - {""}:
            held[s, (re.sub(r"\d", "", w),)].add(i)
    often = {k for k, v in held.items() if len(v) >= 6}
    seen, longest = defaultdict(set), {}
    for i, s, c in rows:
        own = [(n, w) for n, w in enumerate((re.sub(r"\d", "", x) for x in c.split("\n")), 1) if (s, (w,)) in often]
        chains = [(k,) for k in range(len(own))]
        for _ in range(length):
            for x in chains:
                seen[s, tuple(own[k][1] for k in x)].add((i, tuple(own[k][0] for k in x)))
            chains = [(*x, x[-1] + g) for x in chains for g in range(1, gap + 1) if x[-1] + g < len(own)]
    found = {k: v for k, v in seen.items() if len({i for i, _ in v}) >= 6}
    for (_, words), v in found.items():
        for i, at in v:
            for n in at:
                longest[i, n] = max(longest.get((i, n), 0), len(words))
    p = rl.SpanParams(max_length=length, max_gap=gap)
    assert sorted((r.source, r.length, r.support) for r in rl.frequent_sequences(df, p).collect()) == sorted((s, len(w), len({i for i, _ in v})) for (s, w), v in found.items())
    assert {(r.id, r.line_no): r.length for r in rl.repeated_lines(df, p).collect()} == longest


@pytest.mark.parametrize(
    ("value", "verdict"),
    [
        ("It ended.", "complete"), ("It ended [+44 chars]", "mark"), ("It end…", "mark"), ("It end�", "mark"), ("<p>It ended.</p", "cut"), ("<p>It ended.", "cut"),
        ("<p>It ended.</p>", "complete"), ("It ended. And th", "tail"), ("My own title", "complete"), ("It ended. J Doe, The Paper", "complete"), ("Said “no.”", "complete"), ("", None), ("   ", None),
    ],
)
def test_read_end(value, verdict):
    if verdict:
        assert tr.read_end(value, "My own title", "The Paper")[0] == verdict


def test_cut_values(spark):
    rows = [(i, "content", "a", "The Paper", f"t {chr(97 + i)}", f"The minister agreed with number {i}. Read more") for i in range(8)]
    rows += [(20, "content", "a", "The Paper", "t", "The minister agr"), (21, "content", "a", None, None, "The minister agreed with"), (22, "content", None, "P", "t", None), (23, "content", "a", "P", "t", " "), (24, "content", "a", "P", "t", "word " * 60_000 + "end.")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "id long, field string, source string, source_name string, title string, value string, words int")
    found = {r.id: r for r in tr.cut_values(df).collect()}
    assert {i for i, r in found.items() if r.is_cut} == {20, 21}
    assert found[20].reason == "word" and found[21].reason == "sentence" and 22 not in found and 23 not in found
    rates = {(r.source, r.field): (r.stored, r.cut) for r in tr.cut_rates(tr.cut_values(df)).collect()}
    assert rates == {("a", "content"): (11, 2)}
    assert tr.cut_values(df.limit(0)).count() == 0


def page(k):
    body = [f"The council of town {chr(97 + k)} met on Monday, and after a long debate, it agreed on plan {chr(97 + j)}{chr(98 + k)} for the school." for j in range(3)]
    lines = ["Skip to content", "Home | World | Sport", "By Jo Do | The Paper", body[0], f"A subhead {chr(97 + k)} between", "Advertisement", body[1], f"Read also: other story {chr(97 + k)}", body[2]]
    return lines + ["© The Paper, all rights are reserved to us and nobody else at all.", "Related stories", f"Another headline {chr(97 + k)}", "About us | Terms"]


def test_main_lines(spark):
    pages = [(k, "The Paper", f"title {chr(97 + k)}", "\n".join(page(k)), "x") for k in range(8)]
    marked = ["<p>Skip to content</p>", '<div class="nav">Home</div>', f"<p>{page(9)[3]}</p>", "<h2>A subhead between</h2>", '<p class="promo">Read also: nothing</p>', f"<p>{page(9)[6]}</p>", "<aside>", f"<p>{page(9)[8]}</p>", "</aside>"]
    pages += [(20, "The Paper", "t", "\n".join(marked), "x"), (21, None, None, None, "x"), (22, "P", "t", "", "x"), (23, "P", "t", "no paragraph", "x"), (24, "P", "t", page(9)[3] + "\n" + "long " * 40_000 + "text.", "x"), (None, "P", "t", "x", "x")]
    df = spark.createDataFrame(pages, "id long, source_name string, title string, content string, marks string")
    got = defaultdict(list)
    for r in mc.main_lines(df).collect():
        got[r.id].append(r.line_no)
    assert all(sorted(got[k]) == [4, 5, 7, 9] for k in range(8))
    assert sorted(got[20]) == [3, 4, 6] and sorted(got[24]) == [1, 2]
    assert set(got) == {*range(8), 20, 24}
    text = {r.id: r for r in mc.main_text(df).collect()}
    assert text[20].text.startswith("The council") and "<" not in text[20].text and text[23].lines == 0
    assert mc.main_lines(df.limit(0)).count() == 0


def kept(content):
    return [x.text for x in mc.body(content, "", {}, mc.ContentParams())]


def test_links_are_not_the_body():
    links = [f'<p><a href="/{k}">The council met on Monday, and after a long debate, it agreed on plan {k}.</a></p>' for k in range(12)]
    body = [f"<p>{page(9)[3]}</p>", f'<p>{page(9)[6]} See <a href="/x">the plan</a>.</p>']
    content = "\n".join(['<div class="x">', *links, "</div>", '<div class="y">', *body, "</div>"])
    assert kept(content) == [page(9)[3], f"{page(9)[6]} See the plan."]
    # A page on one line is a tree too.
    assert kept(content.replace("\n", "")) == kept(content)


def test_sibling_boxes_of_the_same_kind_are_kept():
    box = lambda cls, *lines: [f'<div class="{cls}">', *(f"<p>{x}</p>" for x in lines), "</div>"]
    a, b, c = page(9)[3], page(9)[6], page(9)[8]
    content = "\n".join([*box("part", a, b), "<nav><a href='/'>Home</a></nav>", *box("part", c, a), *box("other", b, c)])
    assert kept(content) == [a, b, c, a]
    assert kept("</div></p><p>" + a) == [a] and kept("<div") == [] and kept("<a>") == []


PHRASES = {
    "en": "The council said on Monday that the plan for the new harbour would cost more than expected and that nobody was told",
    "de": "Der Rat sagte am Montag, dass der Plan für den neuen Hafen mehr kosten werde als erwartet und niemand es wusste",
    "fr": "Le conseil a dit lundi que le projet du nouveau port coûterait plus que prévu et que personne ne le savait",
}


def test_languages(spark):
    rows = [(k * 10 + j, lang, f"{PHRASES[lang]} Name{k}{j}.\n{PHRASES[lang][20:]} Name{j}.", "x") for k, lang in enumerate(PHRASES) for j in range(8)]
    rows += [(90, "en", f"{PHRASES['de']}.\n{PHRASES['de'][10:]}\n{PHRASES['fr']}.", "x"), (91, None, PHRASES["fr"], "x"), (92, "FR-be", PHRASES["fr"], "x"), (93, "en", None, "x"), (94, "en", "", "x"), (95, "en", "12 34", "x"), (96, "deu", (PHRASES["de"] + "\n") * 300, "x")]
    df = spark.createDataFrame(rows, "id long, label string, content string, lang string")
    found = lg.languages(df)
    assert {tuple(r) for r in lg.wrong_labels(found).collect()} == {(90, 0, "de"), (90, 3, "fr"), (91, 0, "fr")}
    assert all(0 <= r.confidence <= 1 for r in found.collect())
    assert not {93, 94, 95} & {r.id for r in found.collect()}
    assert lg.languages(df.limit(0)).count() == 0


@pytest.mark.parametrize(("label", "code"), [("en-GB", "en"), ("Français", "fr"), ("ger", "de"), ("pt_BR", "pt"), ("??", None), ("", None), (None, None), ("n/a", None)])
def test_label_code(label, code):
    assert lg.label_code(label) == code


def test_mixture(spark):
    docs = [(i, "big", "some words of text " * 5, "x") for i in range(200)] + [(1000 + i, "small", "other words " * 10, "x") for i in range(5)]
    docs += [(2000, None, "text", "x"), (2001, "big", None, "x"), (2002, "small", "", "x"), (2003, "unlisted", "text", "x"), (None, "big", "text", "x")]
    df = spark.createDataFrame(docs, "id long, source string, text string, copy string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 4), ("absent", 0.1, 9), (None, 0.1, 1), ("unlisted", None, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mx.mixture(df, targets, mx.MixParams(drift=(("small", 3.0),)))
    rows = mixed.collect()
    got = {r.source: r for r in report.collect()}
    assert abs(got["big"].reached_share - 7 / 9) < 0.02 and abs(got["small"].reached_share - 2 / 9) < 0.02
    assert got["small"].max_copy == 4 and got["absent"].tokens == 0 and got["absent"].target_share == 0.1
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 for r in rows)
    late = [r.position for r in rows if r.source == "small"]
    assert sum(p > 0.5 for p in late) > len(late) * 0.55  # the weight rises
    assert len({(r.id, r.copy) for r in rows}) == len(rows) and not {r.id for r in rows} & {2000, 2001, 2002, 2003}
    empty, none = mx.mixture(df.limit(0), targets)
    assert empty.count() == 0 and all(r.reached_share == 0 for r in none.collect())


def test_ordinary_lengths_of_a_large_source_are_no_limits(spark):
    def ranking(k, length):
        start = f"Table of the week\n1. q{''.join(chr(97 + int(c)) for c in str(k))} "
        return start + "b" * (length - len(start) - 4) + " zug"

    # Eight ends of each length at one source; at the other, few ends and one length of many.
    rows = [(k, "content", "large", "L", f"t{k}", ranking(k, 100 + k % 80)) for k in range(640)]
    rows += [(1000 + k, "content", "small", "S", f"u{k}", ranking(1000 + k, 150 if k < 8 else 100 + 9 * k)) for k in range(14)]
    df = spark.createDataFrame(rows, "id long, field string, source string, source_name string, title string, value string")
    found = {r.id for r in tr.cut_values(df).where("is_cut").collect()}
    assert found == {1000 + k for k in range(8)}
