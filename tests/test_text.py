import base64
import json

from pyspark.sql import functions as F

from docloom.functions import html, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


def test_citations(spark):
    cite = lambda p: one(spark, text.docs_citation(F.col("p"), "https://d.example/docs"), p=p)
    assert cite("content/en/docs/a/b.md") == "https://d.example/docs/a/b"
    assert cite("content/en/docs/a.b/c.tar.gz") == "https://d.example/docs/a.b/c.tar"
    assert cite("content/en/docs/.hidden") == "https://d.example/docs/.hidden"
    assert cite("other/x.md") == "https://d.example/docs/other/x.md"
    assert cite("content/en/docs-x/y.md") == "https://d.example/docs/content/en/docs-x/y.md"
    assert one(spark, text.code_citation(F.col("c"), F.lit("o/r"), F.lit("a.py")), c="") == "https://github.com/o/r/blob/main/a.py"


def test_issue_markdown_round_trip(spark):
    comments = F.array(F.struct(F.lit(None).cast("string").alias("author"), F.lit("2024-01-02").alias("created_at"), F.lit("yes").alias("body")))
    markdown = text.issue_markdown(F.lit("T"), F.lit("o/r"), F.lit(7), F.lit("https://u.example"), F.lit("a, b"), F.lit("open"), F.lit("2024-01-01"), F.lit(None), F.lit("body"), comments)
    expected = (
        "# T\n\n**Repository:** o/r\n**Issue:** #7\n**URL:** https://u.example\n**Labels:** a, b\n**State:** open\n**Created:** 2024-01-01\n**Updated:** \n\nbody"
        "\n\n---\n**Comment by @unknown** (2024-01-02):\nyes"
    )
    assert one(spark, markdown) == expected
    meta = spark.range(1).select(text.parsed_issue(markdown).alias("m")).first()["m"].asDict()
    assert meta == {"title": "T", "repo_name": "o/r", "issue_number": 7, "issue_state": "open", "issue_labels": "a, b", "citation_url": "https://u.example"}
    empty = spark.range(1).select(text.parsed_issue(F.lit(None).cast("string")).alias("m"))
    assert empty.select(text.is_empty_metadata(F.col("m"))).first()[0]


def test_labels_do_not_cross_lines(spark):
    found = one(spark, text.parsed_issue(F.col("c"))["issue_labels"], c="**Labels:** \n**State:** open")
    assert found == ""


def test_prefix_leaves_out_empty_parts(spark):
    meta = F.struct(F.lit("T").alias("title"), F.lit("").alias("repo_name"), F.lit(3).alias("issue_number"), F.lit("open").alias("issue_state"), F.lit("").alias("issue_labels"))
    assert one(spark, text.issue_prefix(meta)) == "[Issue #3] T | State: open\n\n"


def test_stems_and_urls(spark):
    assert set(one(spark, text.stems(F.lit("Pipelines the PIPELINE run 2024x")))) == {"pipeli", "2024x"}
    assert one(spark, text.answer_urls(F.lit("see [a](https://a.example/1) and https://b.example/2."))) == ["https://a.example/1", "https://b.example/2"]
    assert one(spark, text.source_urls(F.lit("**Source:** https://a.example\nx\n**Source:** https://a.example"))) == ["https://a.example"]


def test_chat_helpers(spark):
    assert one(spark, text.chat_name(F.lit("  how do I  fix it"))) == "how do I"
    assert one(spark, text.link_text(F.lit("https://" + "a" * 70))) == "a" * 57 + "..."
    assert one(spark, text.incoming_message(F.col("m")), m='{"message": "hi"}') == "hi"
    assert one(spark, text.incoming_message(F.col("m")), m="plain") == "plain"
    assert one(spark, text.tool_arguments(F.lit('{"query": "q"}'))) == ("q", 5)
    assert one(spark, text.last_event_data(F.lit("event: m\ndata: {1}\n\ndata: {2}\n"))) == "{2}"
    assert one(spark, text.chosen_answer(F.lit(" "), F.array(F.lit("a"), F.lit("b ")))) == "ab"
    assert one(spark, text.first_token(F.lit(" "), F.lit(None), F.lit("t"))) == "t"


def test_token_claims(spark):
    claims = {"iss": "i", "sub": "s", "iat": 1, "exp": 1801}
    token = "x." + base64.urlsafe_b64encode(json.dumps(claims).encode()).decode().rstrip("=") + ".y"
    assert one(spark, text.token_claims(F.lit(token))).asDict() == claims
    assert one(spark, text.base64url(F.lit("a>b?c~").cast("binary"))) == base64.urlsafe_b64encode(b"a>b?c~").decode().rstrip("=")


def test_html():
    assert html.text_of_html("<p>a <b>b</b></p><script>x</script><!-- c -->d &amp; e") == "a b d & e"
    assert html.text_of_html("") == "" and html.text_of_html(None) is None
    assert html.html_of_markdown("**a** <b>\n`x<y`") == "<strong>a</strong> &lt;b&gt;<br><code>x&lt;y</code>"
    assert html.html_of_markdown("[t](https://a.example)") == '<a href="https://a.example" target="_blank" rel="noopener noreferrer">t</a>'
    assert "javascript" in html.html_of_markdown("[t](javascript:alert(1))") and "<a" not in html.html_of_markdown("[t](javascript:alert(1))")
    assert html.html_of_markdown("```py\na < b\n```") == "<pre><code>a &lt; b\n</code></pre>"


def test_undecodable_content_is_null(spark):
    good, bad = base64.b64encode("ä".encode()).decode(), base64.b64encode(b"\xff\xfe").decode()
    df = spark.createDataFrame([(good,), (bad,), (None,)], "c string")
    assert [r[0] for r in df.select(html.decoded_content(F.col("c"))).collect()] == ["ä", None, None]
