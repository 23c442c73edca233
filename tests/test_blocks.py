"""Block trees from a source that lists in pages, fails in places and shows a block twice."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from quarry.sources import blocks, pages

TREE = {
    "p": [("a", "paragraph"), ("t", "table"), ("c", "child_page"), ("s", "synced")], "a": [(f"a{i}", "paragraph") for i in range(7)], "a3": [("deep", "paragraph")], "deep": [("deeper", "quote")],
    "t": [("r1", "table_row"), ("r2", "table_row")], "c": [("inner", "paragraph")], "q": [("s", "synced"), ("broken", "toggle")], "s": [("x", "paragraph")], "x": [("s", "synced")], "empty": [],
}


def client():
    """Two results a page; children of `broken` and page `down` fail. Each listing leaves a line in a file."""
    at = Path("/tmp") / f"quarry-blocks-{Path(__file__).stat().st_ino}"

    def fetch(kind, above, cursor, size):
        if above in ("broken", "down"):
            raise OSError("down")
        start = int(cursor or 0)
        if not start:
            with at.open("a") as log:
                log.write(above + "\n")
        own = TREE.get(above, [])
        shown = [{"id": i, "type": t, "has_children": i in TREE or i == "broken"} for i, t in own[start : start + 2]]
        return {"results": shown, "has_more": start + 2 < len(own), "next_cursor": str(start + 2)}

    client.log = at
    return fetch


def expected(page):
    """block, parent of a page's tree, each block once, by a plain walk."""
    out, todo = {}, [(page, None)]
    while todo:
        above, parent = todo.pop(0)
        for i, t in TREE.get(above, []):
            if i not in out:
                out[i] = parent
                if t != "child_page":
                    todo.append((i, i))
    return out


def test_trees_are_listed_once_and_whole(spark):
    client()
    client.log.unlink(missing_ok=True)
    asked = spark.createDataFrame([("p",), ("q",), ("p",), ("down",), ("empty",), (None,)], "page_id string")
    got = blocks.read_blocks(asked, "tests.test_blocks:client")
    rows = got.collect()
    for page in ("p", "q", "down", "empty"):
        assert {r["block_id"]: r["parent_id"] for r in rows if r["page_id"] == page} == expected(page)
    assert len(rows) == len({(r["page_id"], r["block_id"]) for r in rows})
    listings = client.log.read_text().split()
    client.log.unlink()
    assert len(listings) == len(set(listings)) and "c" not in listings
    flat = pages.flatten_blocks(got).filter("page_id = 'p'").orderBy("pos").collect()
    assert [r["block_id"] for r in flat] == ["a", "a0", "a1", "a2", "a3", "deep", "deeper", "a4", "a5", "a6", "t", "c", "s", "x"]
    assert blocks.read_blocks(asked.filter(F.lit(False)), "tests.test_blocks:client").isEmpty()
