import datetime as dt
import xml.etree.ElementTree as ET

from shelfwise import feeds
from shelfwise.operators import listing as L

NS = {"a": feeds.ATOM, "dc": feeds.DUBLIN_CORE}


def test_acquisition_feed(spark):
    day = dt.datetime(2024, 5, 1, 12, 30)
    rows = [(1, "paper", 'A & B <i>"x"</i>\x01', "Text", 2020, "en", "J", "10.1/a", None, "ab12", day), (2, "book", "Plain", "", None, None, None, None, "2101.00001", None, day)]
    items = spark.createDataFrame(rows, "id long, item_type string, title string, abstract string, publication_year int, language string, venue string, doi string, arxiv_id string, content_hash string, added_at timestamp")
    names = spark.createDataFrame([(1, ["Ann Doe", "B & C"])], "item_id long, names array<string>")
    root = ET.fromstring(feeds.acquisition(feeds.entries(items, names).orderBy("id"), "Recent", "/opds/recent", "2024-05-01T00:00:00Z", 120, 50, 50).encode())
    one, two = root.findall("a:entry", NS)
    text = lambda e, n: e.findtext(n, namespaces=NS)
    assert (text(one, "a:id"), text(one, "a:title"), text(one, "a:updated"), text(one, "a:summary"), text(one, "dc:issued")) == ("urn:doi:10.1/a", 'A & B <i>"x"</i>', "2024-05-01T12:30:00Z", "Text", "2020")
    assert [a.text for a in one.findall("a:author/a:name", NS)] == ["Ann Doe", "B & C"]
    assert [x.get("rel") for x in one.findall("a:link", NS)] == [feeds.DOWNLOAD, "alternate"] and [x.get("rel") for x in two.findall("a:link", NS)] == ["alternate"]
    assert (text(two, "a:id"), text(two, "a:summary"), two.find("a:category", NS).get("label")) == ("urn:arxiv:2101.00001", None, "Book")
    assert [x.get("rel") for x in root.findall("a:link", NS)] == ["self", "start", "search", "first", "prev", "next", "last"]
    assert "offset=100&limit=50" in root.findall("a:link", NS)[-1].get("href")


def test_navigation_feed_and_page_links():
    root = ET.fromstring(feeds.navigation([("By year & more", "/opds/years", "All years")], "Start", "/opds", "2024-05-01T00:00:00Z").encode())
    assert root.findtext("a:entry/a:title", namespaces=NS) == "By year & more"
    assert L.page_links(0, 0, 50) == {} and L.page_links(51, 0, 50) == {"next": 50, "last": 50} and L.page_links(51, 50, 50) == {"first": 0, "prev": 0}


def test_feed_of_a_library(spark):
    from shelfwise.library import Library

    root = ET.fromstring(Library.load(spark, "/root/testdata/sf0.001").feed("Recent", "/opds/recent", "2024-05-01T00:00:00Z", limit=5, item_type="paper").encode())
    updated = [e.findtext("a:updated", namespaces=NS) for e in root.findall("a:entry", NS)]
    assert len(updated) == 5 and updated == sorted(updated, reverse=True)
