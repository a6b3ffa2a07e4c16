import json

from pressmill.sources import files, items, pages


def frame(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "item string")


def test_raw_csv_to_mentions(spark, tmp_path):
    (tmp_path / "@twitter_1.csv").write_text("full_text,created_at,likes\nhello,2025-03-14 16:17:49,3.0\n")
    rows = files.alias_columns(files.read_raw_csv(spark, [str(tmp_path / "@twitter_1.csv")]).drop("text", "date"), "twitter")
    got = files.conform_mentions(rows).first()
    assert (got.text, got.likes, got.platform, str(got.date)) == ("hello", 3, "twitter", "2025-03-14 16:17:49")


def test_flatteners(spark):
    tweet = items.flatten_tweets(frame(spark, {"id": "1", "fullText": "t", "likeCount": 2, "author": {"userName": "u"}})).first()
    assert (tweet.post_id, tweet.text, tweet.likes, tweet.user_name) == ("1", "t", 2, "u")
    page = items.flatten_facebook(frame(spark, {"pageName": "p", "posts": [{"postId": str(i), "text": "x"} for i in range(12)]}))
    assert page.count() == 10 and page.first().page_name == "p"
    sub = {"id": "9", "hashtags": [{"name": "a"}, {"name": "b"}], "videoMeta": {"subtitleLinks": [{"language": "eng-US", "source": "MT", "downloadLink": "m"}, {"language": "eng-US", "source": "ASR", "downloadLink": "s"}]}}
    clip = items.flatten_tiktok(frame(spark, sub)).first()
    assert (clip.hashtags, clip.subtitle_url) == ("a, b", "s")
    news = items.flatten_news(frame(spark, {"q": {"googleNews": [{"title": "t", "link": "https://a.com.ng/x"}]}})).first()
    assert (news["query"], news.country) == ("q", "nigeria")
    assert items.flatten_instagram(frame(spark, {"ownerUsername": "qa_news"})).first().country == "qatar"
    assert items.flatten_social_search(frame(spark, {"posts": [{"network": "web", "text": "x"}]})).first().source == "News"
    assert items.flatten_youtube(frame(spark, {"id": {"videoId": "v"}}, {"id": {"videoId": "v"}})).count() == 1


def test_articles(spark):
    html = "<h1>A long headline</h1><script>x()</script><p>" + "word " * 20 + "</p><a href='/n'>n</a><a href='/n'>n</a>"
    df = spark.createDataFrame([(1, "http://a.b/c", html), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.extract_articles(df).collect()}
    assert got[1].is_article and got[1].title == "A long headline" and got[1].links == ["http://a.b/n"] and "x()" not in got[1].body
    assert not got[2].is_article


def test_pages_are_taken_apart_in_bounded_pieces(spark):
    seen = spark.sparkContext.accumulator(0)

    def parse(frames):
        for pdf in frames:
            assert len(pdf) == 1 or pdf["html"].fillna("").str.len().sum() <= 1 << 20
            seen.add(1)
            yield pdf[["page_id"]]

    df = spark.range(40, numPartitions=1).selectExpr("id as page_id", "cast(null as string) as url", "if(id = 3, null, repeat('x', 200000 * if(id = 7, 10, 1))) as html")
    assert sorted(r.page_id for r in pages.in_pieces(df, parse, "page_id long").collect()) == list(range(40))
    assert seen.value >= 8


def test_append_dedup_and_export(spark, tmp_path):
    old = spark.createDataFrame([(1, "u1", "a"), (2, None, "b")], "id long, url string, text string")
    new = spark.createDataFrame([(3, "u1", "c"), (4, "u2", "b"), (5, "u3", "d")], "id long, url string, text string")
    assert sorted(r.id for r in files.append_dedup(new, old, ["url", "text"], ["id"]).collect()) == [1, 2, 5]
    files.export_csv(old, str(tmp_path / "x"), ["id", "missing"])
    assert spark.read.csv(str(tmp_path / "x"), header=True).where("missing = 'N/A'").count() == 2


def test_registry_and_taxonomy(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"ministry": "power", "issue_count": 2,\n "issues": [{"slug": "x", "label": "X", "mention_count": 3}, {"slug": "y", "label": "Y", "mention_count": 1}]}')
    (tmp_path / "r" / "b.json").write_text('{"ministry": "works", "issue_count": 0, "issues": []}')
    (tmp_path / "r" / "notes.txt").write_text("no JSON")
    rows = files.read_issue_registry(spark, str(tmp_path / "r"))
    assert sorted((r.ministry, r.slug, r.mention_count) for r in rows.collect()) == [("power", "x", 3), ("power", "y", 1)]
    (tmp_path / "t.csv").write_text("ministry_key,ministry_name,subcategory_key,subcategory_name\npower,Power,grid,The Grid\n")
    assert [tuple(r) for r in files.read_taxonomy(spark, str(tmp_path / "t.csv")).collect()] == [("power", "Power", "grid", "The Grid")]


def test_append_sink_and_public_record(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", float("nan")), (2, "b", 0.5)], "user_id long, text string, score double")
    for _ in range(2):
        files.append_mentions(rows, str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert stored.count() == 4 and {x.name for x in (tmp_path / "m").iterdir() if x.is_dir()} == {"user_id=1", "user_id=2"}
    assert sorted((r.text, r.score) for r in files.to_public_record(rows).collect() if r.score is not None) == [("b", 0.5)]


def test_page_links_and_dates(spark):
    html = """<h2>Minister opens a bridge</h2><p>On 3 May 2024, and on 2024-05-04, much was said about the bridge.</p>
    <div class="pagination"><a href="/p/2">go</a></div><a href="/more">More from Works</a><a href="?page=3">x</a><a href="/n">Next</a><a href="/seven">7</a><a href="#top">2</a><br>"""
    from pressmill.sources import pages

    row = pages.extract_articles(spark.createDataFrame([(1, "https://a.b/", html), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert row[0].title == "Minister opens a bridge" and row[0].is_article and row[0].date_text == "2024-05-04" and row[0].link == "https://a.b/p/2"
    assert row[0].sections == ["https://a.b/more"] and row[0].further_pages == ["https://a.b/p/2", "https://a.b/?page=3", "https://a.b/n", "https://a.b/seven"]
    assert not row[1].is_article and row[1].link is None


def test_several_articles_of_a_page(spark):
    html = """<html><body><nav><a href="/">home</a></nav><section class="content"><h2>All the stories</h2>
      <article class="story"><h3>First <b>story</b> here</h3><script>var x = "</article>";</script><p>a long enough text of the first one<br> on May 3, 2024 <a href="/one">more</a></article>
      <div class="card"><h4>Second story here</h4><p>a long enough text of the second one, 05/06/2024</p></div>
      <div class="card"><h4>Short</h4><p>a long enough text without a title of some length</p></div>
      <div class="card"><h4>Skipped story here</h4><p>a long enough text about football</p></div>
      <div class="card"><p>no heading here, but a long enough text</p></div></section>"""
    links = '<a href="/x">short</a><a href="/news/1">this link has a text that is long enough</a><a href="/q">another that says government at some length</a><a href="/z">nothing that is wanted in this longer text</a><a href="/news/2">football government link that is long enough</a>'
    rows = [(1, "http://e.com/a/", html), (2, "http://e.com/", links), (3, None, None), (4, "x", "<div class=card>&lt;b"), (5, "http://e.com/", '<div class="item"><h1>A title that repeats</h1>some text that is long enough</div>' * 30)]
    found = pages.segment_articles(spark.createDataFrame(rows, "page_id long, url string, html string"), skip=["football"], news=["government"], addresses=["news"]).collect()
    one = {r.place: (r.kind, r.title, r.link, r.date_text) for r in found if r.page_id == 1}
    # the article by its kind, then the section by its class, which holds it, then cards; headings have no body
    assert one == {0: ("article", "First story here", "http://e.com/one", "May 3, 2024"), 4: ("div", "Second story here", None, "05/06/2024")}
    assert pages.segment_articles(spark.createDataFrame(rows[:1], "page_id long, url string, html string"), skip=[]).where("place = 1").first().title == "All the stories"
    assert [(r.title, r.link) for r in found if r.page_id == 2] == [("this link has a text that is long enough", "http://e.com/news/1"), ("another that says government at some length", "http://e.com/q")]
    assert len([r for r in found if r.page_id == 5]) == 0 and not [r for r in found if r.page_id in (3, 4)]
    repeated = pages.segment_articles(spark.createDataFrame(rows[4:], "page_id long, url string, html string"), skip=[], most=60).collect()
    assert len(repeated) == 30 and {r.kind for r in repeated} == {"div"}
