"""HTML extraction, URL filters, chat formatting, decontamination, token counts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.llm import chat_format as C
from cadence.llm import decontaminate as D
from cadence.llm import html_text as H
from cadence.llm import queries as Q
from cadence.llm import token_counts as T
from cadence.llm import url_filter as U
from tests.llm.util import SMALL, docs, prose, words

# --- HTML ---------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"),
    ("<p>x &amp;lt; y&nbsp;&nbsp;z\n\n w</p>", "x &lt; y z w"),
    ("<nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>Buy</div><article><h1>T</h1><p>One <b>two</b>three<br>four</p>"
     "<aside>side</aside><form>f</form><section class='comments'><p>me too</p></section></article><footer>c</footer>",
     "T\nOne twothree four"),
    ("<div id=menu>m</div><div>body <i>it</i>alic</div><div role='contentinfo'>c</div><script>var a='<p>no</p>';</script>tail", "body italic\ntail"),
    ("<ul><li><a href=x>only a link</a><li>real item</ul>", "real item"),
    ("<div class='cookie-notice'>ok?</div><table><tr><td>1<td>2</table><!-- <p>c</p> --><style>p{}</style>", "1\n2"),
    ("<article><p>shadow casts</p><p class='adverb'>adverbs stay</p></article>", "shadow casts\nadverbs stay"),
    ("<p title='a > b' data-x=don't>quoted</p><p>second's</p>", "quoted\nsecond's"),
    ("<article><p>cut off in the mid", "cut off in the mid"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_kept_between_surge_and_dive():
    lengths = np.array([0, 0, 0, 5, 0, 7, 0, 0, 0, 9, 0, 0])
    assert np.flatnonzero(H.kept_between(lengths)).tolist() == [3, 5, 9]
    assert not H.kept_between(np.zeros(4, np.int64)).any() and not len(H.kept_between(np.zeros(0, np.int64)))


def unmarked(*blocks):
    return "<body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body>"


def test_window_sums_decide_on_pages_without_marks():
    text = [prose(i, n) for i, n in ((1, 30), (2, 3), (3, 60), (4, 20))]
    menu, foot = ["Home", "About us", "Contact", "Shop", "Log in"], ["Buy now!", "Terms", "Privacy", "Imprint", "© 2024 all rights"]
    assert H.main_text(unmarked(*menu, *text, *foot)) == "\n".join(text)
    notice = "We use cookies to improve this site and to count visits. Go on to accept."
    page = unmarked(notice, "Fine", *menu, "<h1>A title</h1>", *text, *foot)
    assert H.main_text(page) == "\n".join(["A title", *text])
    sums = np.array([4, 8, 7, 4, 300, 12, 250, 6, 5, 9])
    assert np.flatnonzero(H.kept_between(sums)).tolist() == [4, 5, 6]
    assert H.kept_between(sums, marked=True).all()


def test_short_texts_and_far_parts_of_a_page_without_marks_stay():
    assert H.main_text(unmarked("one", "two three", "four")) == "one\ntwo three\nfour"
    far = [prose(1, 400), *["- item"] * 9, prose(2, 30)]
    assert H.main_text(unmarked(*far)) == "\n".join(far)


def test_extract_keeps_rows_and_counts_code_points(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(0, None, "<p>é😀</p>"), (0, None, "<p>é😀</p>")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted([(i, t) for i, (_, t) in enumerate(PAGES)] + [(0, "é😀")] * 2)
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_page_is_linear():
    page = "<article>" + "<p>" + "word " * 20 + "</p>" * 1 + "<div>" * 3 + "x" + "</div>" * 3
    assert H.main_text(page * 3000).count("\n") == 5999


# --- URLs ---------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "a://X.Net", "a://X.Net/", "https://Sub.Example.NET/en/1?q=/de/", "https://example.net/de/1",
        "https://example.com/de/9#x", "https://notexample.com/de/9", "http://a.b.org/fr/", "http://org/fr/x", "http://borg/fr/x",
        "x://h?p=/a", "x://h#/a", "x://h/a#b?c", "ftp://É.net/ä/ö", "x://a.net:80/", "x://y.org/\n/z", "a://b://c/d"]


def brute_url(u):
    host, path = U.split_url(u)
    fits = [r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return host, path, max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def test_urls_rules_and_model(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, None)], "page_id long, url string").selectExpr("*", "1 AS Host")
    out = U.judge(df)
    assert [c.lower() for c in out.columns].count("host") == 1
    rows = out.collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule = brute_url(r.url)
        assert (r.Host if "Host" in r.__fields__ else r.host, r.path) == (host, path)
        assert r.rule == (rule[0] + rule[1] if rule else None)
        assert r.verdict == (rule[2] if rule else "block" if r.block_probability >= 0.5 else "allow")
    assert U.judge(df.limit(0)).count() == 0


def test_url_model_separates_the_labelled_table_and_scores_alone_as_together():
    labelled = U.labelled_urls()
    model = U.fit(labelled)
    parts = [U.split_url(u) for u, _ in labelled]
    together = U.score(model, [h for h, _ in parts], [p for _, p in parts])
    assert np.mean((together >= 0.5) == np.array([y for _, y in labelled])) > 0.98
    for (h, p), x in zip(parts[:20], together):
        assert abs(U.score(model, [h], [p])[0] - x) < 1e-12
    assert len(U.score(model, [], [])) == 0 and U.score(model, [""], [""])[0] < 0.5


def test_url_model_on_names_held_out():
    names = U.site_names()
    held = U.labelled_urls(names[1::4])
    model = U.fit(U.labelled_urls([n for i, n in enumerate(names) if i % 4 != 1]))
    parts = [U.split_url(u) for u, _ in held]
    said = U.score(model, [h for h, _ in parts], [p for _, p in parts]) >= 0.5
    truth = np.array([bool(y) for _, y in held])
    assert np.mean(said == truth) > 0.9
    assert np.mean(said[~truth]) < 0.05


def test_url_score_equals_brute_force():
    model = U.fit(U.labelled_urls())
    place = {}  # n-gram -> its weight's place, one for each
    for host, path in map(U.split_url, [*URLS, "http://m.Casino-poker.org/en/12?x", "https://www.gardening.net/de/"]):
        data = b"\x01" + f"{host}\x02{path}".replace("\x00", " ").encode("utf-8", "surrogatepass") + b"\x01"
        grams = [data[i:i + n] for n in U.SIZES for i in range(len(data) - n + 1)]
        _, found = U.hashed_ngrams([f"{host}\x02{path}"])
        assert len(found) == len(grams) and all(place.setdefault(g, f) == f for g, f in zip(grams, found.tolist()))
        counts = {}
        for g in grams:
            counts[place[g]] = counts.get(place[g], 0) + 1
        norm = sum(c * c for c in counts.values()) ** 0.5
        z = model.bias + sum(c / norm * model.weights[g] for g, c in counts.items())
        assert abs(1 / (1 + np.exp(-z)) - U.score(model, [host], [path])[0]) < 1e-9


# --- chats --------------------------------------------------------------------

ODD = ["<|", "<\\|", "<\\\\|", "<", "<\\", "|>", "a\nb", "\\n", "\\b\\", C.END + "\n", C.START + "user\n", "", "$1 \\$", None]


def test_chat_round_trip(spark):
    said = [(r, t) for r in [*ODD, "assistant"] for t in ODD]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(said)]
    random.Random(1).shuffle(rows)
    turns = C.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = C.read_back(C.format_chats(turns)).first()
    assert [(x.role, x.text) for x in r.turns] == [(a or "", b or "") for a, b in said]
    assert r.loss_texts == [t or "" for t in ODD]
    for s in r.loss_spans:
        assert r.formatted[s.start + s.length:].startswith(C.END + "\n")


def test_chat_query_equals_brute_force(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", Q.FORGED), (-1, 1, "assistant", Q.FORGED)]
    expected = {}
    for k in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == k)
        whole = "".join(f"{r}\n{t}\n" for _, r, t in own)
        lost = "".join(t for _, r, t in own if r == "assistant")
        expected[k] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    df = Q.op8_chat_formatting(spark, SMALL)
    assert {r.conv_id: tuple(r)[1:5] for r in df.collect()} == expected
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_layouts_by_fingerprint(spark):
    records = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null,"x":1}],"meta":3}', [("user", "a"), ("assistant", "")]),
        ('{"messages":[{"role":"user","content":"a"}],"system":"s"}', [("system", "s"), ("user", "a")]),
        ('{"instruction":"i","input":"x","output":"o"}', [("user", "i\nx"), ("assistant", "o")]),
        ('{"instruction":"i","input":null,"output":"o"}', [("user", "i"), ("assistant", "o")]),
        ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', [("user", "h"), ("assistant", "g")]),
        ('{"prompt":"p","response":"r","system":"s"}', [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"prompt":"p","completion":"r"}', [("user", "p"), ("assistant", "r")]),
        ('{"question":"q","answer":"a"}', [("user", "q"), ("assistant", "a")]),
        ('{"turn":4,"role":null,"text":"t"}', [("", "t")]),
        ('{"messages":[]}', []), ('{"foo":1}', None), ("no json", None), (None, None),
    ]
    df = C.from_json(spark.createDataFrame([(i, j) for i, (j, _) in enumerate(records)], "conv_id long, j string"), "j")
    got = {}
    for r in sorted(C.canonical_turns(df).collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: t for i, (_, t) in enumerate(records) if t}
    assert sorted(r.conv_id for r in C.unmatched(df).collect()) == [i for i, (_, t) in enumerate(records) if t is None]
    assert len({lay.fingerprint for lay in C.LAYOUTS}) == len(C.LAYOUTS)


EXTRA = {"system": "string", "answer": "string", "input": "string", "prompt": "string", "System": "string",
         "messages": "array<struct<role:string,content:string>>", "conversations": "string", "text2": "int"}


@pytest.mark.parametrize("extra", ["System", "messages", "answer,input,conversations,text2", "prompt,response,system"])
def test_turn_rows_keep_every_turn_beside_known_columns(spark, extra):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", None), (2, 1, None, "c"), (2, None, "assistant", "d")]
    for filled in (True, False):
        df = spark.createDataFrame(rows, "conv_id long, Turn long, role string, TEXT string")
        for name in extra.split(","):
            kind = EXTRA.get(name, "string")
            value = F.from_json(F.lit('[{"role":"user","content":"x"}]'), kind) if kind.startswith("array") else F.lit("7").cast(kind)
            df = df.withColumn(name, F.when(F.lit(filled) & (F.col("Turn") == 0), value))
        got = sorted((r.conv_id, r.turn is None, r.turn, r.role, r.text) for r in C.canonical_turns(df).collect())
        assert got == [(1, False, 0, "user", "a"), (1, False, 1, "assistant", "b"), (2, False, 0, "user", ""), (2, False, 1, "", "c"),
                       (2, True, None, "assistant", "d")]
        assert C.unmatched(df).count() == 0


def test_empty_turn_rows_beside_a_field_of_another_layout(spark):
    df = spark.createDataFrame([(1, None, None, None, "s")], "conv_id long, turn long, role string, text string, system string")
    assert [tuple(r) for r in C.canonical_turns(df).collect()] == [(1, None, "", "")]


def test_records_with_a_further_known_field_take_the_largest_layout(spark):
    df = C.from_json(spark.createDataFrame([(1, '{"instruction":"i","output":"o","answer":"x"}'), (2, '{"prompt":"p","response":"r","completion":"c","system":"s"}'),
                                            (3, '{"answer":"x"}')], "conv_id long, j string"), "j")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in C.canonical_turns(df).collect())
    assert got == [(1, 0, "user", "i"), (1, 1, "assistant", "o"), (2, 0, "system", "s"), (2, 1, "user", "p"), (2, 2, "assistant", "r")]
    assert [r.conv_id for r in C.unmatched(df).collect()] == [3]


def test_chat_nulls_ties_repeats_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    df = spark.createDataFrame([(None, None, None, None, "x"), (None, 1, "user", "b", "x"), (2, 1, "user", "b", "x"),
                                (2, 1, "user", "b", "x"), (2, 1, "assistant", "z", "x")], schema)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in C.read_back(C.format_chats(C.canonical_turns(df))).collect()}
    assert got == {None: [("", ""), ("user", "b")], 2: [("assistant", "z"), ("user", "b"), ("user", "b")]}
    assert C.format_chats(C.canonical_turns(df.limit(0))).count() == 0


# --- decontamination ------------------------------------------------------------

ITEM = "Alice bought 12 apples for 3 dollars each and sold 7 of them to Bob. How many does she have left?"


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_template_tokens():
    t = D.Templates(["Then Mary had 12 kg of 5 apples. Later Bob paid $3!! And 12kg", "", "--- x"])
    assert [(int(k), t.value[r]) for k, r in zip(t.kind, t.rows)] == [
        (D.PLAIN, "then"), (D.NAME, "mary"), (D.PLAIN, "had"), (D.QUANTITY, "12"), (D.PLAIN, "of"), (D.NUMBER, "5"),
        (D.PLAIN, "apples"), (D.PLAIN, "later"), (D.NAME, "bob"), (D.PLAIN, "paid"), (D.NUMBER, "3"), (D.PLAIN, "and"),
        (D.QUANTITY, "12 kg"), (D.PLAIN, "x")]
    assert t.slots(1, 4) == ["mary", "12 kg"] and t.first.tolist() == [0, 13, 13, 14]


def test_reparameterised_copies_are_caught_and_clean_texts_kept(spark):
    other = ITEM.replace("12", "15").replace("3 d", "4 d").replace("7", "9").replace("Bob", "Dan").replace("Alice", "Carla")
    given = [
        (1, prose(1, 30) + " " + ITEM + " " + prose(2, 30)), (2, "x " + other + " y"), (3, ITEM.upper().replace(" ", "\n")),
        (4, " ".join(w + "***" for w in ITEM.split())), (5, prose(3, 200)), (6, None), (7, ""),
        (8, "One man bought 12 apples for 3 dollars and left."),  # part of the wording only
        (9, "x " + other.replace("9 of", "15 of").replace("4 d", "15 d") + " y"),  # still one value for each of the item's
        (10, "x " + ITEM.replace("sold 7", "sold 12") + " y"), (1, "again " + ITEM),
    ]
    got = {r.doc_id: (r.item_id, r.changed_slots) for r in D.contaminated(docs(spark, given), bench(spark, [ITEM, None, "", "one two"])).collect()}
    assert set(got) == {1, 2, 3, 4, 9, 10} and got[1] == (0, 0) and got[2][1] >= 4


def test_inconsistent_slots_do_not_count(spark):
    item = "if 5 birds sit on 5 trees and 5 birds leave then how many of the birds sit there"
    mixed = "if 6 birds sit on 7 trees and 8 birds leave then how many of the birds sit there"
    same = "if 6 birds sit on 6 trees and 6 birds leave then how many of the birds sit there"
    got = D.contaminated(docs(spark, [(1, mixed), (2, same)]), bench(spark, [item])).collect()
    assert [r.doc_id for r in got] == [2]


def test_items_dense_in_numbers_or_names_are_found(spark):
    items = ["What is 12 + 7 - 5 * 3 / 2 ?", "name Alice, Bob, Carol, Dave, Erin, Frank, Grace and Heidi", "The Rise And Fall Of Empires",
             "Solve 7*8 now", "Which river runs dry", "Paul met Mary in Rome when Peter left Paris for London with Anna", "ran 12 kg 5 km"]
    given = [(1, "so what is 12 + 7 - 5 * 3 / 2 ? yes"), (2, "x " + items[1] + " y"), (3, "on the rise and fall of empires it says"),
             (4, "please solve 7*8 now"), (5, "a line\nWhich river runs dry then"), (6, "as " + items[5].lower() + " so"),
             (7, "what is 12 + 7 - 5 * 3 / 4 ?"), (8, "name Alice, Bob, Carol, Dave, Erin and Frank"), (9, "ran 12kg 5 km"),
             (10, "a line\nWhich river runs wet then")]
    got = {(r.doc_id, r.item_id): r.changed_slots for r in D.contaminated(docs(spark, given), bench(spark, items)).collect()}
    assert got == {(1, 0): 0, (2, 1): 0, (3, 2): 0, (4, 3): 0, (5, 4): 0, (6, 5): 0, (9, 6): 0}


def test_edits_cost_windows_not_the_alignment(spark):
    long_ = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(56)).split()
    passage = " ".join([*long_[:20], "5", *long_[20:40], "5", *long_[40:]])
    fruit = "if a boy has 5 red apples in his small bag and puts in 5 more ripe pears from home what is the sum"
    plain = " ".join(f"x{chr(97 + i)}" for i in range(20)).split()
    given = [
        (1, "so " + passage[::-1].replace("5", "7", 1)[::-1] + " end"),  # one of two equal numbers edited
        (2, "so " + fruit.replace("5 red", "7 red").replace("5 more", "9 more") + " end"),
        (3, "so " + " ".join([*plain[:10], "extra", *plain[10:]]) + " end"),
        (4, "so " + " ".join([*plain[:10], *plain[11:]]) + " end"),
        (5, "so " + " ".join(plain[:12]) + " end"),  # less than 13 words of 20
    ]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs(spark, given), bench(spark, [passage, fruit, " ".join(plain)])).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 2)}


def test_short_items_empty_tables_and_clashes(spark):
    df = docs(spark, [(1, "we saw the QUICK brown, fox jumps!"), (2, "the quick")]).selectExpr("*", "1 AS item", "2 AS hash")
    got = D.contaminated(df, bench(spark, ["the quick brown fox jumps", "the quick"]).selectExpr("*", "1 AS hash")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 0)]
    assert D.contaminated(df.limit(0), bench(spark, [ITEM])).count() == 0
    assert D.contaminated(df, bench(spark, [ITEM]).limit(0)).count() == 0


def test_decontamination_query_equals_plain_containment(spark):
    """In the given table items are copied word by word, so containment of all
    words but a few at the ends is what the templates must find."""
    norm = lambda t: [w for w in (D.word_kind(x)[1] for x in words(t)) if w]
    items = {r.item_id: " ".join(norm(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    expected = {(r.doc_id, k) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()
                for d in [" " + " ".join(norm(r.text)) + " "] for k, i in items.items() if f" {i} " in d}
    got = {(r.doc_id, r.item_id) for r in Q.op3_benchmark_decontamination(spark, SMALL).collect()}
    assert expected and got == expected


# --- token counts ---------------------------------------------------------------

def greedy(data, pieces):
    longest, n = max(map(len, pieces)), 0
    while data:
        k = next((k for k in range(min(longest, len(data)), 0, -1) if data[:k] in pieces), 0)
        if not k:
            return 1
        data, n = data[k:], n + 1
    return n


@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=12),
       st.binary(min_size=1, max_size=16).map(lambda b: bytes(97 + x % 3 for x in b)))
@settings(max_examples=400, deadline=None)
def test_automaton_equals_greedy_matching(pieces, data):
    assert T.build(sorted(pieces)).counter().pieces(data) == greedy(data, pieces)


def test_token_counts_on_the_small_table(spark):
    pieces = set(T.byte_pieces(public_tokenizers.path("byte_bpe_50k.json")))
    assert len(pieces) == 50256 and {bytes([b]) for b in range(256)} <= pieces
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = Q.op9_token_counts(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows[:60]:
        each = [greedy(b" " + w.encode(), pieces) for w in words(texts[r.doc_id])]
        assert (r.n_words, r.n_tokens, r.longest_word) == (len(each), sum(each), max(each, default=0))


def test_token_counts_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 2)
    df = docs(spark, [(1, None), (2, ""), (3, "a " * 1000), (3, "a " * 1000), (4, "x" * 100_000)]).selectExpr("*", "1 AS n_tokens")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted((r.doc_id, r.n_words, r.n_tokens) for r in T.count_tokens(df, path, keep=["doc_id", "n_tokens"]).collect())
    assert got[:4] == [(1, 0, 0), (2, 0, 0), (3, 1000, 1000), (3, 1000, 1000)] and got[4][1] == 1
    assert T.count_tokens(df.limit(0), path).count() == 0
