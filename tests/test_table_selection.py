"""Selections whose atoms stay in a table give what those in the driver give."""

import pytest

from shellspark.operators.selection import AtomSelection, TableSelection


def test_as_the_selection_in_the_driver(spark):
    atoms = [10 * k + 7 for k in range(12)]
    rows = spark.createDataFrame([(a, 1 + k % 3 * 2, f"g{1 + k % 3 * 2}") for k, a in enumerate(atoms)], "atom long, group_id int, group_name string")
    table = TableSelection.make(rows, 3)
    plain = AtomSelection.make(atoms, natomspermol=3, group_names=["g1", "2", "g3", "4", "g5"], group_atom_indices=[atoms[0::3], [], atoms[1::3], [], atoms[2::3]])
    assert (table.nmols, table.natomspermol, table.group_names, table.n_groups, table.natoms()) == (plain.nmols, plain.natomspermol, plain.group_names, plain.n_groups, plain.natoms())
    for which in (1, 2, "g3"):
        assert sorted(r.atom for r in table.atom_group(which).collect()) == list(plain.atom_group(which))
    some = [atoms[4], atoms[0], atoms[11]]
    assert table.types(some) == plain.types(some) == [2, 1, 3]
    for own in (table, plain):
        with pytest.raises(ValueError):
            own.types([atoms[0], 8])
        with pytest.raises(ValueError):
            own.atom_group("g2")
    named = TableSelection.make(rows, 3, ("O", "H1", "H2"))
    assert not named.custom_groups and named.group_names == ("O", "H1", "H2")
    with pytest.raises(ValueError):
        TableSelection.make(rows, 5, ("a", "b", "c", "d", "e"))
