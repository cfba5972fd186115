"""Documents of nested vectors, current and legacy."""

import json

import pytest

from shellspark.operators import derived as de
from shellspark.operators.selection import SolventGroup
from shellspark.sinks import nested, persistence

NBINS = 4


def document(version, **changes):
    """A result of 4 bins, as one line without blanks."""
    vectors = {v: [float(k * NBINS + b) for b in range(NBINS)] for k, v in enumerate(nested.VECTORS)}
    solute = {"nmols": 1, "natomspermol": 2, "indices": [1, 2], "custom_groups": False, "group_atom_indices": [], "group_names": ["CA", "CB"]}
    solvent = {"nmols": 2, "natomspermol": 2, "indices": [3, 4, 5, 6], "custom_groups": True, "group_atom_indices": [[3, 5], [4], [4, 6]], "group_names": ["O", "H", "all H"]}
    options = {"firstframe": 1, "lastframe": -1, "stride": 1, "irefatom": -1, "n_random_samples": 10, "binstep": 0.5, "dbulk": 1.0, "cutoff": 2.0, "usecutoff": True, "lcell": 1, "GC": True, "GC_threshold": 0.3, "seed": 321, "StableRNG": False, "nthreads": 0, "silent": False}
    out = {"Version": version, "nbins": NBINS, "dbulk": 1.0, "cutoff": 2.0, **{v: vectors[v] for v in nested.VECTORS[:7]}, "autocorrelation": False, "solute": solute, "solvent": solvent}
    out |= {"solute_group_count": [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]], "solvent_group_count": [[float(g * 10 + b) for b in range(NBINS)] for g in range(3)]}
    if version not in ("2.17.1", "2.10.3"):
        out |= {"solute_group_count_random": [[0.5] * 4, [0.25] * 4], "solvent_group_count_random": [[float(g)] * 4 for g in range(3)]}
    out |= {v: vectors[v] for v in nested.VECTORS[7:]}
    out |= {"density": {"solute": 0.1, "solvent": 0.2, "solvent_bulk": 0.3}, "volume": {"total": 100.0, "bulk": 60.0, "domain": 40.0, "shell": [1.0, 2.0, 3.0, 4.0]}}
    file = {"filename": "a.dcd", "options": options, "irefatom": 1, "lastframe_read": 20, "nframes_read": 20, "frame_weights": []}
    return out | {"files": [file, file | {"filename": "b.dcd", "nframes_read": 10}], "weights": [0.6, 0.4]} | changes


def load(spark, path, doc):
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc, separators=(",", ":")))
    return persistence.load(spark, str(path))


@pytest.mark.parametrize("version", ["2.18.0", "2.17.1", "2.10.3", "2.0.0"])
def test_a_document_of_either_layout(spark, tmp_path, version):
    doc = document(version)
    if version in ("2.17.1", "2.10.3"):
        with pytest.warns(UserWarning, match="random"):
            r = load(spark, tmp_path / "r.json", doc)
    else:
        r = load(spark, tmp_path / "r.json", doc)
    rows = {b.bin: b for b in r.bins.collect()}
    assert all([rows[b + 1][v] for b in range(NBINS)] == doc[v] for v in nested.VECTORS)
    assert [rows[b].shell_volume for b in range(1, 5)] == [1, 2, 3, 4] and rows[1].volume_bulk == 60 and rows[4].density_solvent_bulk == 0.3
    groups = {(g.side, g.group_id, g.bin): (g.n, g.n_random) for g in r.groups.collect()}
    assert len(groups) == 5 * NBINS
    for side in ("solute", "solvent"):
        random = doc.get(f"{side}_group_count_random")
        for g, own in enumerate(doc[f"{side}_group_count"]):
            for b, n in enumerate(own):
                assert groups[side, g + 1, b + 1] == (n, random[g][b] if random else 0.0)
    assert r.options.usecutoff and r.options.nbins == NBINS and r.files == (("a.dcd", 20), ("b.dcd", 10)) and r.weights == (0.6, 0.4) and r.version == version
    assert r.solvent.atom_group("all H") == (4, 6) and r.solute.group_names == ("CA", "CB") and not r.solute.custom_groups
    by_name = de.contributions(r, SolventGroup("H"), "md_count").orderBy("bin").collect()
    assert [x.value for x in by_name] == doc["solvent_group_count"][1]


def test_written_documents_come_back(spark, tmp_path):
    r = load(spark, tmp_path / "r.json", document("2.18.0"))
    back = persistence.load(spark, nested.save(str(tmp_path / "again.json"), r, "2.18.0"))
    assert not de.differences(r, back, 1e-12).count()
    assert (back.options, back.solute, back.solvent, back.files, back.weights) == (r.options, r.solute, r.solvent, r.files, r.weights)
    own = json.loads((tmp_path / "again.json").read_text())
    doc = document("2.18.0")
    assert list(own) == list(doc) and all(own[k] == doc[k] for k in doc if k != "files" and "nmols" not in str(doc[k]))
    with pytest.warns(UserWarning):
        old = persistence.load(spark, nested.save(str(tmp_path / "old.json"), r, "2.17.1"))
    assert "solute_group_count_random" not in json.loads((tmp_path / "old.json").read_text())
    assert old.groups.where("n_random <> 0").count() == 0 and old.groups.count() == r.groups.count()


def test_documents_that_are_none(spark, tmp_path):
    whole = json.dumps(document("2.18.0"))
    shorter = document("2.18.0", md_count=[1.0])
    for bad in (document("1.9.9"), document("99.0.0"), whole[:-40], shorter, document("2.18.0", files=[]), document("2.18.0", solvent=None), '{"nbins": 3}', '{"Version": "2.18.0", "nbins": "x"}'):
        with pytest.raises(ValueError):
            load(spark, tmp_path / "b.json", bad)
