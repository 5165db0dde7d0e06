"""The automaton of globs against regular expressions and a plain reading of the rules."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings, strategies as st

from evenkeel.llm import url_globs
from evenkeel.llm.url_globs import Automaton, glob_rule, host_rule

GLOBS = ["a*b", "**b", "a**", "?[ab]/*", "*", "**", "", "[a-b]?**/", "é*", "a[*]b", "***a", "[", "a*[ab]*b", "/**/a"]


def as_pattern(glob: str) -> str:
    pieces = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.findall(r"\*\*+|\*|\?|\[[^\]]+\]|.", glob, re.S)
    return "".join(
        pieces.get("**" if p.startswith("**") else p) or (p.replace("[*]", r"\*") if len(p) > 1 else re.escape(p)) for p in parts
    )


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/é*[\n", max_size=12), max_size=30), st.lists(st.sampled_from(GLOBS), min_size=1, max_size=20))
def test_globs_fit_as_patterns_do(urls, globs):
    rules = [glob_rule("block", g) for g in globs]
    wanted = []
    for url in urls:
        fits = [n for n, g in enumerate(globs) if re.fullmatch(as_pattern(g), url, re.S)]
        wanted.append(globs[min(fits, key=lambda n: (-len(globs[n]), n))] if fits else None)
    automaton = Automaton(rules)
    assert [n if n is None else automaton.rules[n].name for n in automaton.best(urls)] == wanted


def test_many_words_of_states():
    rules = [host_rule("block", f"host{n}.example", f"/part{n}/") for n in range(300)]
    automaton = Automaton(rules)
    assert automaton.words > 50
    urls = [f"{sub}host{n}.example/part{m}/x" for n in (0, 7, 299) for m in (0, 7, 299) for sub in ("", "a.", "a")]
    names = [n if n is None else automaton.rules[n].name for n in automaton.best(urls)]
    assert names == [f"host{n}.example/part{n}/" if n == m and sub != "a" else None for n in (0, 7, 299) for m in (0, 7, 299) for sub in ("", "a.", "a")]


def plain(url):
    """host, path, rule by the words of the contract."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [("com", "/"), ("example.com", "/en/"), ("www.example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]
    fits = [h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len) if fits else None


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/", "http://a.com", "http://a.com/", "http://a.com?x=/", "x://y://a.com/",
    "http://Example.com/en/1", "http://xexample.com/en/1", "https://WWW.example.com/en/a?b#c", "https://a.www.example.com/en/",
    "http://evil.org/x.com/", "http://evil.org/.net/es/", "http://a.net/es/", "http://a.net/fr", "http://net/fr/", "http://É.net/fr/é\n",
    "http://a.net:80/es/", "http://u@a.net/es/#/", "http://spam-farm.example.org/x", "http://org/spam-farm/x", "http://a.org/b/login.html",
    "http://www.cheap-pills.example.com/en/450", "http://a.org/x.png", "http://a.org/x.jpgx", "http://" + "a" * 200_000 + ".net/es/",
    "http://a.org/" + "x" * 200_000, "http://a.com/", "http://a.com/",
]


def test_rules_of_hosts(spark):
    pages = spark.createDataFrame([(n, u, "v", "h") for n, u in enumerate(URLS)], "page_id long, url string, verdict string, host string")
    found = {r.row.page_id: r for r in url_globs.judge(pages).collect()}
    assert len(found) == len(URLS)
    for n, url in enumerate(URLS):
        host, path, rule = plain(url)
        assert (found[n].host, found[n].path, found[n].rule) == (host, path, rule), url and url[:60]
        if rule:
            assert found[n].verdict == ("allow" if rule in ("com/", "www.example.com/en/") else "block")
            continue
        fits = [r.name for r in url_globs.GLOB_RULES if re.fullmatch(as_pattern(r.name), host + path, re.S)]
        assert found[n].verdict == ("block" if fits else "allow") and found[n].pattern == (max(fits, key=len) if fits else None)
    assert url_globs.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("glob", GLOBS)
def test_one_long_url(glob):
    automaton = Automaton([glob_rule("block", glob)])
    for url in ("a" * 5000 + "b", "b/" * 3000 + "a", "ab" * 2000):
        assert (automaton.best([url])[0] == 0) == bool(re.fullmatch(as_pattern(glob), url, re.S))
