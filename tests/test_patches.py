"""Patches and hunks against plain Python."""

import random

from lorekeep import schema as S
from lorekeep.operators import patches


def test_hunks_give_the_new_text(spark):
    rng = random.Random(7)
    line = lambda: rng.choice(["a", "b", "", "c d", "ü", " "])
    rows = [(str(k), old := "\n".join(line() for _ in range(rng.randrange(12))), "\n".join(x for x in (old.split("\n") + [line()]) if rng.random() < 0.8)) for k in range(120)]
    rows += [("none", None, "x"), ("gone", "x\ny", None), ("same", "s", "s"), ("both", None, None), ("ends", "a\n", "a"), ("long", "x\n" * 3000, "x\n" * 2999 + "y\n")]
    pairs = spark.createDataFrame(rows, "id string, old string, new string").repartition(3)
    found = patches.hunks(pairs)
    got = {r.id: r.new for r in patches.rebuilt(pairs, found).collect()}
    assert got == {i: new or "" for i, _, new in rows}
    assert {r.id for r in found.collect()} == {i for i, old, new in rows if (old or "") != (new or "")}
    assert patches.rebuilt(pairs.limit(0), patches.hunks(pairs.limit(0))).count() == 0


def test_what_patches_do(spark):
    names = spark.createDataFrame([], S.CONCEPT).columns
    human, bot = [("human:x", None)], [("bot", None)]
    given = {"plain": None, "machine": bot, "titled": bot, "human": human, "open": human, "linked": None, "relinked": None, "idle": bot, "blank": None, "nothing": None}
    bodies = {"linked": "text\n\n## Links\n\n- [a](b)\n", "relinked": "text\n\n## Links\n\n- [a](b)\n"}
    c = spark.createDataFrame([tuple({"id": i, "title": "t", "body": bodies.get(i, "text"), "verified": v, "status": "stable"}.get(n) for n in names) for i, v in given.items()], S.CONCEPT)
    asked = [("plain", None, "new", None), ("machine", None, "new", False), ("titled", " n ", None, False), ("human", "n", None, False), ("open", "n", None, True), ("linked", None, "new\n\n", None), ("relinked", None, "new\n\n## Links\n\n- [c](d)\n", None), ("idle", "t", "text", None), ("blank", "\t", "x", None), ("nothing", None, None, None), ("absent", "n", None, None)]
    table = spark.createDataFrame(asked, "id string, title string, body string, downgrade boolean")
    got = {r.id: r for r in patches.patched(c, table).collect()}
    assert {i: r.outcome for i, r in got.items()} == {"plain": "updated", "machine": "updated", "titled": "updated", "human": "refused", "open": "updated", "linked": "updated", "relinked": "updated", "idle": "no change", "blank": "empty", "nothing": "empty", "absent": "missing"}
    assert {i for i, r in got.items() if r.lost_trust} == {"machine", "open"} and got["titled"].verified and got["machine"].verified is None and got["titled"].title == "n"
    assert got["linked"].body == "new\n\n## Links\n\n- [a](b)\n" and got["relinked"].body == "new\n\n## Links\n\n- [c](d)\n" and got["human"].title == "t" and got["linked"].changed == ["body"]
    after = {r.id: r for r in patches.apply(c, table).collect()}
    assert set(after) == set(given) and after["machine"].verified is None and after["human"].verified and after["plain"].body == "new" and all(r.status == "stable" for r in after.values())
