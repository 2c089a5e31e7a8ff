"""What is below unchanged archives has no part in pairing, and is not even read."""

import io
import zipfile

from tidemark import api
from tidemark.config import load
from tidemark.plans import engine
from tidemark.sources import files
from test_engine import write


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def seen(found):
    return sorted((n.action, n.source, n.path) for n in found.root.walk() if n.action != "modify" or n.edits)


INNER = {"a.txt": "the text of a\n", "d/b.csv": "id,v\n1,2\n3,4\n"}
CLOSED = {"dataset": {"correspondence": {"expand_renamed_unchanged_collections": False}}}


def test_visible(spark):
    items = engine.local(spark, [(p,) for p in ("a.zip", "a.zip/>x", "a.zip/>i.zip/>y", "b.zip/>x", "b.zip/>i.zip", "b.zip/>i.zip/>y", "c")], "path string")
    links = engine.local(spark, [("a.zip", "q", "same content"), ("b.zip/>i.zip", "r", "copy"), ("c", "c", "moved")], engine.LINKS)
    left = {r["path"] for r in engine.visible(items, links, "left", engine.SETTLED).collect()}
    assert left == {"a.zip", "b.zip/>x", "b.zip/>i.zip", "c"}
    paths = {r["path"] for r in items.collect()}
    assert paths - engine.below_settled(paths, {"a.zip", "b.zip/>i.zip"}) == left


def test_unchanged_archives_stay_closed(spark, tmp_path):
    same, before, after = zipped(INNER), zipped({"x.txt": "1\n"}), zipped({"x.txt": "2\n"})
    a = write(tmp_path / "a", {"same.zip": same, "changed.zip": before})
    b = write(tmp_path / "b", {"same.zip": same, "changed.zip": after})
    left, right = files.closed_archives(spark, a, b, load(None))
    assert [r["path"] for r in left.collect()] == [r["path"] for r in right.collect()] == ["same.zip"]
    items = files.scan(spark, a, load(None), left)
    assert {r["path"]: r["container"] for r in items.collect()} == {"same.zip": True, "changed.zip": True, "changed.zip/>x.txt": False}
    assert seen(api.diff(spark, a, b)) == [("modify", "changed.zip/>x.txt", "changed.zip/>x.txt")]


def test_a_copied_archive_is_one_copy(spark, tmp_path):
    a = write(tmp_path / "a", {"one.zip": zipped(INNER), "t.txt": "t\n"})
    b = write(tmp_path / "b", {"one.zip": zipped(INNER), "two.zip": zipped(INNER), "t.txt": "t\n"})
    assert seen(api.diff(spark, a, b)) == [("copy", "one.zip", "two.zip")]


def test_what_came_out_of_a_renamed_archive(spark, tmp_path):
    a = write(tmp_path / "a", {"old.zip": zipped(INNER)})
    b = write(tmp_path / "b", {"new.zip": zipped(INNER), "out.txt": INNER["a.txt"]})
    assert seen(api.diff(spark, a, b)) == [("copy", "old.zip/>a.txt", "out.txt"), ("move", "old.zip", "new.zip")]
    found = api.diff(spark, a, b, CLOSED)
    assert seen(found) == [("add", None, "out.txt"), ("move", "old.zip", "new.zip")]
    left, right = files.closed_archives(spark, a, b, load(CLOSED))
    assert [r["path"] for r in left.collect()] == ["old.zip"] and [r["path"] for r in right.collect()] == ["new.zip"]


def test_renamed_archives_of_equal_bytes_are_opened(spark, tmp_path):
    """Two on one side: which of them moved is for pairing to say."""
    a = write(tmp_path / "a", {"p.zip": zipped(INNER), "q.zip": zipped(INNER)})
    b = write(tmp_path / "b", {"r.zip": zipped(INNER)})
    left, right = files.closed_archives(spark, a, b, load(CLOSED))
    assert left.count() == right.count() == 0
    found = api.diff(spark, a, b, CLOSED)
    assert [x for x in seen(found) if x[0] == "move"] == [("move", "p.zip", "r.zip")]
    assert all(p.startswith("q.zip") for action, _, p in seen(found) if action == "remove")


def test_a_folder_renamed_with_all_below_is_one_move(spark, tmp_path):
    below = {"readme.txt": "r\n", "reports/annual.txt": "an\n", "reports/quarterly/q1.txt": "1\n", "reports/quarterly/q2.txt": "2\n"}
    a = write(tmp_path / "a", {f"docs/{k}": v for k, v in below.items()})
    b = write(tmp_path / "b", {f"documentation/{k}": v for k, v in below.items()})
    found = api.diff(spark, a, b)
    assert seen(found) == [("move", "docs", "documentation")] and found.tags() >= {"move", "folder-move"}


def test_an_archive_renamed_around_a_renamed_and_edited_table(spark, tmp_path):
    rows = [f"{i},tree {i},{12 * i}\n" for i in range(1, 11)]
    old, new = "id,name,score\n" + "".join(rows), "id,name,score\n" + "".join([*rows[:4], "5,tree 5,61\n", *rows[5:]])
    a, b = write(tmp_path / "a", {"data.zip": zipped({"old.csv": old})}), write(tmp_path / "b", {"archive.zip": zipped({"new.csv": new})})
    found = api.diff(spark, a, b)
    assert seen(found) == [("move", "data.zip", "archive.zip"), ("move", "data.zip/>old.csv", "archive.zip/>new.csv")]
    assert [e["params"] for e in found.find("archive.zip/>new.csv").edits if e["verb"] == "tabular.edit_cell"] == [{"row": 4, "column": "score", "from": "60", "to": "61"}]
    assert found.tags() >= {"folder-move", "move", "move.modified"}
