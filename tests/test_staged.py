"""Staged merges: killed anywhere and resumed, refused plans, gates, rewrites, undo."""

import pytest
from quillgraph.operators import staged
from quillgraph.operators.staged import Reference, Refused, Store
from quillgraph.plans.staged import ORGANIZATION, PERSON, merge_people

PEOPLE = "id long, name string, status string, merged_into long"


def people_store(spark, root):
    df = spark.createDataFrame
    store = Store(spark, root)
    store.create(
        people=df([(i, f"P{i}", "active", None) for i in range(1, 8)], PEOPLE),
        threads=df([(1, [2, 1, 2]), (2, [3]), (3, None), (4, [2, 1, 3, 2, 5])], "id long, person_ids array<long>"),
        commitments=df([(1, 2), (2, 3), (3, None)], "id long, person_id long"),
        meetings=df([(1, [4, 3]), (2, [])], "id long, person_ids array<long>"),
        follow_ups=df([(1, 2)], "id long, person_id long"),
        projects=df([(1, [6, 7, 6])], "id long, person_ids array<long>"),
        knowledge_items=df([(1, 2), (1, 2), (2, 1)], "id long, person_id long"),
        reply_drafts=df([(1, 4)], "id long, person_id long"),
        calendar_actions=df([(1, 0, 5, ["x@y.example"]), (2, 0, 2, []), (3, 0, 4, None)], "id long, place long, person_id long, attendees array<string>"),
    )
    return store


def plan_of(spark, *pairs):
    return spark.createDataFrame([(*p, True) for p in pairs], "old long, new long, approved boolean")


def contents(store):
    return {t: sorted(map(repr, (r.asDict() for r in store.table(t).collect()))) for t in store.manifest()["tables"]}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    store = people_store(spark, str(tmp_path_factory.mktemp("whole")))
    run, mapping = merge_people(store, plan_of(spark, (2, 1), (4, 3), (6, 5)), "merge")
    return contents(store), run, mapping


def test_merge_by_hand(whole):
    found, run, mapping = whole
    assert {(r.old, r.new) for r in mapping.collect()} == {(2, 1), (4, 3)}  # 5 has an action with attendees: all of it is blocked
    assert run.done["version"] == 1 and len(run.steps) == 9
    lists = {r["id"]: r["person_ids"] for r in map(eval, found["threads"])}
    assert lists == {1: [1], 2: [3], 3: None, 4: [1, 3, 5]}
    assert found["projects"] == ["{'id': 1, 'person_ids': [6, 7, 6]}"]  # not referred to: not touched
    assert {(r["id"], r["person_id"]) for r in map(eval, found["commitments"])} == {(1, 1), (2, 3), (3, None)}
    assert len(found["knowledge_items"]) == 3 and all("'person_id': 1" in r for r in found["knowledge_items"])
    assert {r["id"]: (r["status"], r["merged_into"]) for r in map(eval, found["people"])} == {1: ("active", None), 2: ("merged", 1), 3: ("active", None), 4: ("merged", 3), **{i: ("active", None) for i in (5, 6, 7)}}


class Killed(Exception):
    pass


def test_killed_anywhere_and_resumed(spark, tmp_path, whole, monkeypatch):
    """The process dies at each of the run's notes, before or after it is there; the next start ends in the same tables."""
    real = staged.put_new
    store, plan, tries = people_store(spark, str(tmp_path)), plan_of(spark, (2, 1), (4, 3), (6, 5)), 0
    for after in (False, True, False, True, False, True, False, False, True, True, False, False, True, True) * 3:
        count = 0

        def note(s, path, text, die_after=after):
            nonlocal count
            count += 1
            if count == 2:  # one note gets through
                if die_after:
                    real(s, path, text)
                raise Killed
            real(s, path, text)

        monkeypatch.setattr(staged, "put_new", note)
        tries += 1
        try:
            merge_people(store, plan, "merge")
            break
        except Killed:
            assert store.version() == 1 or store.manifest() == store.manifest(0)  # nothing is seen before the end
    assert 5 < tries < 42 and contents(store) == whole[0]
    monkeypatch.setattr(staged, "put_new", real)
    again, _ = merge_people(store, plan, "merge")
    assert again.done["version"] == store.version() == 1 and contents(store) == whole[0]


def test_refused_plans(spark, tmp_path):
    store = people_store(spark, str(tmp_path))
    with pytest.raises(Refused, match="no row"):
        merge_people(store, plan_of(spark, (2, 1)).selectExpr("old", "new", "false as approved"), "a")
    for pairs, fault in (([(2, 2)], "self"), ([(2, 1), (1, 3)], "chained"), ([(2, 1), (2, 3)], "multi_target"), ([(99, 1)], "unknown"), ([(2, 1), (2, 1)], "repeated")):
        with pytest.raises(Refused, match=fault):
            merge_people(store, plan_of(spark, *pairs), "a")
    assert store.version() == 0 and staged.ledger(store, "a") is None
    merge_people(store, plan_of(spark, (2, 1)), "b")
    with pytest.raises(Refused, match="another plan"):
        merge_people(store, plan_of(spark, (4, 3)), "b")


def test_two_runs_from_one_manifest_and_undo(spark, tmp_path):
    store = people_store(spark, str(tmp_path))
    before = contents(store)
    one = [staged.Step("x", "commitments", lambda read: read("commitments").selectExpr("id", "person_id + 10 as person_id"))]
    late = [staged.Step("y", "follow_ups", lambda read: (staged.execute(store, "one", plan_of(spark, (1, 2)), one), read("follow_ups"))[1])]
    with pytest.raises(Refused, match="another run"):
        staged.execute(store, "late", plan_of(spark, (3, 4)), late)  # while it was writing, the other ended
    assert store.manifest()["run"] == "one" and contents(store)["commitments"] != before["commitments"]
    assert staged.undo(store, "one") == 2 and contents(store) == before
    with pytest.raises(Refused, match="changed since"):
        staged.undo(store, "one")
    with pytest.raises(Refused, match="not ended"):
        staged.undo(store, "late")


def test_faults_after_the_steps_keep_the_old_tables(spark, tmp_path):
    store = people_store(spark, str(tmp_path))
    mapping = plan_of(spark, (2, 1)).select("old", "new")
    steps = [s for s in staged.merge_steps(PERSON, mapping, "people", "id") if s.table != "threads"]  # a table is forgotten
    with pytest.raises(Refused, match="threads"):
        staged.execute(store, "run", mapping, steps, staged.stray(PERSON, mapping))
    assert store.version() == 0


def test_organizations_take_names_blanks_and_facts(spark, tmp_path):
    df = spark.createDataFrame
    store = Store(spark, str(tmp_path))
    scalars = {r.table: df([(1, 2), (2, 1), (3, None)], "id long, org_id long") for r in ORGANIZATION if r.scalars and r.table != "knowledge_items"}
    store.create(
        organizations=df([(1, "One", ["Uno"], None, "active", None), (2, "Two", ["Uno", "Dos"], "two.example", "active", None), (3, "Three", None, "three.example", "active", None)], "id long, name string, aliases array<string>, website string, status string, merged_into long"),
        knowledge_items=df([(1, 2, "works_at", "Two"), (2, 2, "likes", "Two"), (3, 1, "works_at", "One")], "id long, org_id long, predicate string, current_value string"),
        threads=df([(1, [3, 2, 1]), (2, [2])], "id long, org_ids array<long>"), **scalars,
    )
    mapping = df([(2, 1), (3, 1)], "old long, new long")
    steps = staged.merge_steps(ORGANIZATION, mapping, "organizations", "id", {"knowledge_items": staged.works_at(mapping, "organizations", "id", "name")}, staged.absorbing(mapping, "id", "name", "aliases", ["website"]))
    staged.execute(store, "run", mapping, steps, staged.stray(ORGANIZATION, mapping))
    orgs = {r.id: r.asDict() for r in store.table("organizations").collect()}
    assert (orgs[1]["name"], orgs[1]["aliases"], orgs[1]["website"], orgs[1]["status"]) == ("One", ["Uno", "Dos", "Two", "Three"], "two.example", "active")
    assert (orgs[2]["status"], orgs[2]["merged_into"], orgs[2]["website"]) == ("merged", 1, "two.example")
    assert sorted((r.id, r.org_id, r.current_value) for r in store.table("knowledge_items").collect()) == [(1, 1, "One"), (2, 1, "Two"), (3, 1, "One")]
    assert sorted(r.org_ids for r in store.table("threads").collect()) == [[1], [1]]
    assert {r.org_id for r in store.table("meetings").collect()} == {1, None}


def test_checksum_tells_every_damage_and_no_order(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "b")]
    df = lambda x: spark.createDataFrame(x, "old long, name string")
    right = staged.checksum(df(rows))
    assert staged.checksum(df(rows[::-1]).select("name", "old").repartition(3)) == right
    for bad in (rows[:-1], [*rows, (3, "b")], [(1, "a"), (2, None), (3, "b"), (3, "b")], [(1, "b"), (2, None), (2, None), (3, "a")], [(1, "a"), (2, ""), (2, None), (3, "b")], []):
        assert staged.checksum(df(bad)) != right


def test_lists_of_rows_without_a_hit_stay(spark):
    mapping = spark.createDataFrame([(1, 9)], "old long, new long")
    rows = spark.createDataFrame([(1, [5, 5]), (2, [1, 9, 1]), (3, []), (4, None)], "id long, v array<long>")
    got = {r.id: r.v for r in staged.repointed_list(rows, mapping, ("id",), "v").collect()}
    assert got == {1: [5, 5], 2: [9], 3: [], 4: None}
    assert Reference("t", ("id",)).lists == ()
