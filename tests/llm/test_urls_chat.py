import hashlib
import random

from pyspark.sql import functions as F

from tickerloom.llm import chat, urls

PAGES = "page_id long, url string, html string, host string, `_row` string, kind string"


def judge(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, otherwise)


def run(spark, found, rules):
    df = spark.createDataFrame([(i, u, None, "clash", "r", "k") for i, u in enumerate(found)], PAGES)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urls.judged(df, table)
    assert got.columns == ["page_id", "url", "html", "_row", "kind", "host", "path", "rule", "verdict"]
    return {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got.collect()}


def test_urls_by_hand(spark):
    r = random.Random(5)
    hosts = ["net", "example.net", "www.example.net", "ample.net", "org", "a.b.org", "example.com", "x\u00e9.net", "net.net", ""]
    paths = ["/", "/en", "/en/", "/en/x", "/enx", "/de/", "", "/EN/", "/en/x\U0010FFFF", "/\u00ff"]
    rules = [("net", "/", "block"), ("net", "/en", "allow"), ("net", "/en/", "block"), ("example.net", "/en/", "allow"), ("example.net", "", "block"), ("org", "/en/x", "allow"),
             ("www.example.net", "/", "allow"), ("b.org", "/en", "block"), ("net", "/", "allow")]
    found = [None, "no scheme", "://", "http://", "a://b://c/d", "http://NET/En/", "http://net?x/en/", "http://net#/en/"]
    found += [f"{r.choice(['http', 'HTTPS'])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=/en/', '#t'])}" for _ in range(300)] + ["http://www.example.net/en/x"] * 200
    got = run(spark, found, rules)
    unique = [(h, p, max(v for a, b, v in rules if (a, b) == (h, p))) for h, p in {(h, p) for h, p, _ in rules}]
    assert got == {i: judge(u, unique) for i, u in enumerate(found)}


def test_urls_without_rules_or_pages(spark):
    assert run(spark, ["http://a/b", None], []) == {0: ("a", "/b", None, "allow"), 1: ("", "", None, "allow")}
    assert run(spark, [], [("net", "/", "block")]) == {}


TURNS = "conv_id long, turn long, role string, text string, window string, formatted string, `_at` string"


def turns(spark, rows):
    return spark.createDataFrame([(*x, "w", "f", "a") for x in rows], TURNS)


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    out = {}
    for c, xs in by.items():
        xs.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in xs)
        trained = "".join(x for _, _, r, x in xs if r == "assistant")
        out[c] = (len(xs), hashlib.sha256(said.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    r = random.Random(6)
    bits = ["</turn>", "\n", "### ", "####", "\\", "\\/", "<\\/turn>", ": ", "### assistant: ", "word ", "\U0001F600", "#", "<", ""]
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 30)):
            role = "system" if t == 0 and c % 2 else r.choice(["user", "assistant", "assistant", "a:b\\", "</turn>"])
            rows.append((c, t, role, "".join(r.choice(bits) for _ in range(r.randrange(0, 60)))))
    rows += [(100, 0, None, None), (101, None, "assistant", "x"), (101, 1, "assistant", ""), (None, 0, "assistant", "n"), (102, 0, "system", "only"), (103, 0, "assistant", "long " * 3000), (103, 1, "assistant", "end")]
    rows += [(104, 0, "assistant", "same")] * 3
    for budget, history in ((40, 12), (512, 128)):
        made = chat.windows(turns(spark, rows), budget=budget, history=history).cache()
        got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.digests(made).collect()}
        assert got == expected(rows)
        examples = chat.read_back(made).collect()
        assert sum(x.n_context > 0 for x in examples) > 10 or budget > 40
        for x in examples:
            assert x.formatted.count("</turn>\n") == x.formatted.count("</turn>") and "\n### " not in x.formatted.replace("</turn>\n### ", "")
            if x.conv_id is not None and x.conv_id % 2 and x.conv_id < 40:
                assert x.formatted.startswith("### system: ")
            assert all(0 <= s.start <= s.end <= len(x.formatted) for s in x.loss)
        made.unpersist()


def test_chat_budget_and_history(spark):
    rows = [(1, 0, "system", "be nice")] + [(1, t, "user" if t % 2 else "assistant", "w " * 6) for t in range(1, 41)]
    made = sorted(chat.windows(turns(spark, rows), budget=100, history=30).collect(), key=lambda x: x.window)
    assert len(made) > 5 and all(x.tokens <= 100 for x in made)
    assert [x.n_context for x in made[1:]] == [1 + 3] * (len(made) - 1) and made[0].n_context == 0
    assert sum(len(x.loss) for x in made) == 20


def test_chat_windows_over_budget_hold_one_new_turn_and_no_history(spark):
    """Turns of all lengths behind system turns of all lengths: only the system turn and a single turn may be over the budget; no room is wasted on avoidable cuts."""
    r = random.Random(8)
    rows = []
    for c in range(150):
        system = r.choice([None, 2, 20, 55, 70, 94, 95, 96, 97, 200])
        if system:
            rows.append((c, 0, "system", "s " * system))
        rows += [(c, t, r.choice(["user", "assistant"]), "w " * r.choice([0, 1, 5, 20, 40, 60, 90, 96, 97, 300])) for t in range(1, r.randrange(2, 25))]
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((role, len(text.split()) + chat.TEMPLATE_TOKENS))
    over = 0
    for x in chat.read_back(chat.windows(turns(spark, rows), budget=100, history=30)).collect():
        lead = by[x.conv_id][0][1] if by[x.conv_id][0][0] == "system" else 0
        fresh = [len(t.text.split()) + chat.TEMPLATE_TOKENS for t in x.turns if t.role != "system"]
        assert x.tokens - lead - sum(fresh) <= 30
        if x.tokens > 100:
            over += 1
            assert lead >= 100 and x.tokens - lead <= 100 or len(fresh) <= 1 and x.tokens == lead + sum(fresh)
    assert over > 20


def test_chat_empty(spark):
    assert chat.digests(chat.windows(turns(spark, []))).count() == 0
    assert chat.windows(turns(spark, [(1, 0, "user", "a")])).select(F.size("loss")).first()[0] == 0
