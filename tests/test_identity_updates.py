"""Identities kept up to date against whole runs, with records that join persons, and keys that stay."""

import random

import pytest

from ledgerloom.operators import identity, identity_updates

FIELDS = "node long, system string, source_id long, name string, tax_id string, email string, phone string, city string, region string, signed_up date"
VALID = ["52998224725", "11144477735", "12345678909", "98765432100"]


def records(rng, n):
    some = lambda *xs: rng.choice(xs)
    return [
        (k, some("L", "E"), rng.randrange(10**6) * n + k, some(" José ", "JOSE", "Ana", "Rui", "ana", None), some(*VALID, *VALID, "12345678900", "52998224724", "1", None), some("a@x.com", "b@x.com", "A@x.com", *(f"{j}@x" for j in range(9)), None), some("1", "2", None, ""), some("Recife", "N/A", None), some("PE", None), None)
        for k in rng.sample(range(10 * n), n)
    ]


def result(members, persons):
    gold, bridge, _ = identity.finished(members, persons)
    golden = {r.person: {c: r[c] for c in gold.columns if c != "person_key"} for r in gold.collect()}
    keys = {r.person: r.person_key for r in persons.collect()}
    roles = {r.node: (r.person, r.role, r.system_role, r.person_key) for r in bridge.collect()}
    return golden, keys, roles


@pytest.mark.parametrize("seed", [1, 2])
def test_added_equals_a_whole_run(spark, seed):
    rng = random.Random(seed)
    rows = records(rng, 90)
    frame = lambda part: spark.createDataFrame(part, FIELDS)
    parts = [rows[:50], rows[50:65], rows[65:]]
    state = identity_updates.start(frame(parts[0]))
    before = result(state.members, state.persons)
    seen, owner = list(parts[0]), {node: r[3] for node, r in before[2].items()}
    n_merged = 0
    for part in parts[1:]:
        state = identity_updates.add(state, frame(part))
        seen += part
        golden, keys, roles = result(state.members, state.persons)
        whole, _, whole_roles = result(*identity.first_run(frame(seen)))
        assert golden == whole
        assert {n: r[:3] for n, r in roles.items()} == {n: r[:3] for n, r in whole_roles.items()}
        assert len(set(keys.values())) == len(keys)
        aliases = {r.person_key: r.into for r in state.aliases.collect()}
        assert not set(aliases) & set(keys.values()) and set(aliases.values()) <= set(keys.values())
        # a known record keeps its person's key, or that key is an alias of the one it has now; keys are not used again
        assert all(roles[node][3] == aliases.get(key, key) for node, key in owner.items())
        fresh = {roles[r[0]][3] for r in part} - set(owner.values())
        assert not fresh or min(fresh) > max(owner.values())
        n_merged = len(aliases)
        owner |= {node: r[3] for node, r in roles.items() if node not in owner}
    assert n_merged
    same = identity_updates.add(state, frame(parts[2]))  # a repeated load
    assert result(same.members, same.persons) == (golden, keys, roles) and sorted(same.aliases.collect()) == sorted(state.aliases.collect())


def test_a_record_that_joins_two_persons(spark):
    """Node 5 has the tax id and name of person 10 and the e-mail, phone and name of person 20: the smaller key stays, the
    smaller node names the person, and the next new person does not get the key given up."""
    row = lambda node, source, tax, email, name="Ana": (node, "L", source, name, tax, email, "1", None, None, None)
    frame = lambda *part: spark.createDataFrame(list(part), FIELDS)
    state = identity_updates.start(frame(row(10, 2, VALID[0], None), row(20, 1, None, "a@x"), row(30, 3, None, None, "Rui")))
    assert {r.person: r.person_key for r in state.persons.collect()} == {20: 1, 10: 2, 30: 3}
    state = identity_updates.add(state, frame(row(5, 9, VALID[0], "a@x")))
    assert {r.person: (r.person_key, r.rules) for r in state.persons.collect()} == {5: (1, "CPF_VALIDO_NOME+DUPLICATA_LEGADO"), 30: (3, None)}
    assert [tuple(r) for r in state.aliases.collect()] == [(2, 1)]
    state = identity_updates.add(state, frame(row(6, 4, None, "new@x", "Eva"), row(7, 4, None, "new@x", "Eva")))
    assert {r.person: r.person_key for r in state.persons.collect()} == {5: 1, 30: 3, 6: 4}
    nothing = identity_updates.add(state, frame(row(5, 9, None, None)).limit(0))
    assert sorted(nothing.persons.collect()) == sorted(state.persons.collect())


def test_from_nothing(spark):
    """An empty first run, then a group a third of which is one person."""
    none = identity_updates.start(spark.createDataFrame([], FIELDS))
    hot = [(k, "L", k, "Ana", VALID[0] if k % 3 == 0 else None, f"{k}@x", None, None, None, None) for k in range(300)]
    state = identity_updates.add(none, spark.createDataFrame(hot, FIELDS))
    keys = sorted(r.person_key for r in state.persons.collect())
    assert keys == list(range(1, 202)) and state.members.where("person = 0").count() == 100 and none.persons.count() == 0
