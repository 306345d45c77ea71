from hypothesis import given, settings, strategies as st
import pytest

from quarry.operators.chunking import _packs, _tail, chunk_text
from quarry.operators.passages import windows
from quarry.settings import Settings
from quarry.sources.articles import (
    articles_to_documents, blocks_text, decoded, markup_text, merge_articles, parse_timestamp,
)


def test_packs():
    assert list(_packs(["aaaa", "bb", "cccc", "d"], 7)) == [["aaaa", "bb"], ["cccc", "d"]]


def test_tail_keeps_whole_units():
    assert _tail(["a", "b" * 300], 180) == ["b" * 300]
    assert _tail(["a", "b" * 400], 180) == []
    assert _tail(["x" * 100, "a" * 79, "b" * 100], 180) == ["a" * 79, "b" * 100]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n!", min_size=0, max_size=120), max_size=12))
def test_chunks_cover_every_word(parts):
    text = "\n".join(parts)
    chunks = chunk_text(text, 60, 10)
    assert sorted(set(text.split())) == sorted(set(" ".join(chunks).split())) or any(len(w) > 60 for w in text.split())
    # size plus at most one overlap tail
    assert all(len(c) <= 60 + 1 + 20 for c in chunks)


@pytest.mark.parametrize("markup, text", [
    ("<p>a</p><script>x</script><p>b&nbsp;c</p>", "a\n\nb c"),
    ("<noscript>z</noscript>t<br>u", "t\nu"),
    ("t<br/>u", "t\n\nu"),                                   # a self-closed tag opens and closes
    ("a<!-- <p>no</p> -->b<style>p{}", "ab"),
    ('<a title="x > y">link</a> <prefix>t</prefix>', "link t"),
    ("<P CLASS='q'>one</P >two<b", "one\ntwo"),
    ("2 < 3 &lt;b&gt; &amp;amp; &copy &#8364; &#x41; &#150; &unknown; &", "2 < 3 <b> & \u00a9 \u20ac A \u2013 &unknown; &"),
    (None, ""), ("", ""), (" \u00a0\t", ""),
])
def test_html(one, markup, text):
    assert one(lambda c: markup_text(c.cast("string")), markup) == text


@given(st.lists(st.sampled_from(["&", "#", "x", "65", ";", "amp", "lt", "notit", "hellip", " ", "1F600", "not", "eacute"]), max_size=9))
@settings(max_examples=40, deadline=None)
def test_references_as_the_standard_library(one, parts):
    import html
    assert one(decoded, "".join(parts)) == html.unescape("".join(parts))


def test_editor_blocks(one):
    raw = '{"blocks":[{"type":"header","data":{"text":"<b>T</b>"}},{"data":{"items":["one","two", 3, null, " "]}}]}'
    assert one(blocks_text, raw) == "header\nT\none\ntwo"
    assert one(blocks_text, "<p>x</p>") == "x"


def test_timestamp(one):
    assert str(one(parse_timestamp, "2024-01-02T03:04:05Z")) == "2024-01-02 03:04:05"
    assert one(parse_timestamp, "x").year == 1970


def test_articles(spark):
    summaries = spark.createDataFrame(
        [(1, "A", "p1", "s"), (2, "B", "", "s"), (3, "C", "only preview", "s")], "id long, name string, preview string, section_id string")
    details = spark.createDataFrame(
        [(1, "A2", "<p>body</p>", None, "public", "2024-01-02"), (2, None, "", None, "archive", "bad"), (3, None, None, None, "archive", None)],
        "id long, name string, content string, editor_type string, status string, updated_at string")
    docs = {r.doc_id: r for r in articles_to_documents(merge_articles(summaries, details), "https://kb.local/").collect()}
    assert docs["1"].title == "A2" and docs["1"].content == "body" and docs["1"].is_actual
    assert docs["1"].version == "2024-01-02T00:00:00+00:00"
    assert "2" not in docs and docs["3"].content == "only preview" and not docs["3"].is_actual


def test_windows(one):
    w = one(lambda c: windows(c, 50, 10), " ".join(f"word{i}" for i in range(40)))
    assert all(x.text and not x.text.startswith(" ") for x in w) and [x.k for x in w] == sorted(x.k for x in w)
    assert one(lambda c: windows(c, 50, 10), "  ") == []


def test_settings_invariants():
    for bad in ({"chunk_overlap_chars": 1400}, {"weak_threshold": 0.7}, {"response_budget_seconds": 30.0},
                {"passage_overlap_chars": 500}, {"rerank_candidate_k": 4}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings(embedding_dimension=767).embedding_dimension == 768


def test_stages_are_cleared(spark, tmp_path, monkeypatch):
    from quarry import session

    monkeypatch.setattr(session, "stage_root", lambda _: str(tmp_path / "stages"))
    assert session.materialize(spark.range(5), "five").count() == 5
    assert [p.name.split("-")[0] for p in (tmp_path / "stages").iterdir()] == ["five"]
    assert session.clear_stages(spark) and not (tmp_path / "stages").exists()
