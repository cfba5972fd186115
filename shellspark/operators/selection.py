"""Selections: a small language for atoms, selections of molecules, groups."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import settled

#: Residue classes.
ACIDIC = ("ASP", "GLU")
BASIC = ("ARG", "LYS", "HIS", "HSD", "HSE", "HSP")
UNCHARGED_POLAR = ("ASN", "CYS", "GLN", "GLY", "SER", "THR", "TYR")
NONPOLAR = ("ALA", "ILE", "LEU", "MET", "PHE", "PRO", "TRP", "VAL")
WATER = ("HOH", "OH2", "TIP3", "TIP3P", "TIP4P", "TIP5P", "TIP7P", "SPC", "SPCE", "SOL", "WAT")
BACKBONE = ("N", "CA", "C", "O")
PROTEIN = ACIDIC + BASIC + UNCHARGED_POLAR + NONPOLAR
ONE_LETTER = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "HSD": "H", "HSE": "H", "HSP": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}

_RESIDUES = {"protein": PROTEIN, "water": WATER, "acidic": ACIDIC, "basic": BASIC, "polar": ACIDIC + BASIC + UNCHARGED_POLAR, "nonpolar": NONPOLAR, "charged": ACIDIC + BASIC, "neutral": UNCHARGED_POLAR + NONPOLAR}
_TEXT = {"name": "name", "resname": "resname", "chain": "chain", "element": "element", "segname": "segname"}
_NUMBER = {"resnum": "resnum", "residue": "residue", "index": "atom_index", "index_pdb": "index_pdb", "model": "model", "beta": "beta", "occup": "occup", "x": "x", "y": "y", "z": "z"}
_WORDS = {*_RESIDUES, *_TEXT, *_NUMBER, "backbone", "sidechain", "all", "and", "or", "not", "(", ")"}


def predicate(text: str) -> Column:
    """A selection such as ``protein and not resnum 3 4`` or ``(name O or resnum >= 7)`` as a Column."""
    tokens = re.findall(r"[()]|<=|>=|==|[<>=]|[^\s()<>=]+", text)
    if not tokens:
        raise ValueError("the selection is empty")
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"the selection ends too early: {text!r}")
        at += 1
        return tokens[at - 1]

    def either() -> Column:
        out = both()
        while peek() == "or":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = negated()
        while peek() == "and":
            take()
            out = out & negated()
        return out

    def negated() -> Column:
        if peek() == "not":
            take()
            return ~negated()
        return one()

    def one() -> Column:
        word = take()
        if word == "(":
            out = either()
            if take() != ")":
                raise ValueError(f"a parenthesis is not closed: {text!r}")
            return out
        if word == "all":
            return F.lit(True)
        if word in _RESIDUES:
            return F.col("resname").isin(*_RESIDUES[word])
        if word == "backbone":
            return F.col("resname").isin(*PROTEIN) & F.col("name").isin(*BACKBONE)
        if word == "sidechain":
            return F.col("resname").isin(*PROTEIN) & ~F.col("name").isin(*BACKBONE)
        if word in _TEXT or word in _NUMBER:
            return field_test(word)
        raise ValueError(f"unknown word {word!r} in the selection {text!r}")

    def field_test(word: str) -> Column:
        column = F.col(_TEXT.get(word) or _NUMBER[word])
        kind = (lambda v: v) if word in _TEXT else float
        op = take() if peek() in ("<", "<=", ">", ">=", "=", "==") else None
        if op in (None, "=", "=="):
            values = [kind(take())]
            while (p := peek()) is not None and p not in _WORDS:
                values.append(kind(take()))
            return column.isin(*values)
        value = float(take())
        return {"<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[op]

    out = either()
    if at < len(tokens):
        raise ValueError(f"{tokens[at]!r} was not expected in the selection {text!r}")
    return out


def select(atoms: DataFrame, selection: str | Column) -> DataFrame:
    return atoms.where(predicate(selection) if isinstance(selection, str) else selection)


@dataclass(frozen=True)
class AtomSelection:
    """Atoms of like molecules, in order; groups are the atoms of a molecule, or custom sets of atoms, which may overlap."""

    indices: tuple[int, ...]
    nmols: int
    natomspermol: int
    group_names: tuple[str, ...] = ()
    group_atom_indices: tuple[tuple[int, ...], ...] = ()

    @classmethod
    def make(cls, indices, *, nmols: int | None = None, natomspermol: int | None = None, group_names=None, group_atom_indices=None) -> AtomSelection:
        indices = tuple(int(i) for i in indices)
        if not indices:
            raise ValueError("the selection has no atoms")
        if nmols is None and natomspermol is None:
            raise ValueError("nmols or natomspermol is needed")
        if nmols is None:
            if natomspermol < 1 or len(indices) % natomspermol:
                raise ValueError("the number of atoms is not a multiple of natomspermol")
            nmols = len(indices) // natomspermol
        if nmols < 1 or len(indices) % nmols:
            raise ValueError("the number of atoms is not a multiple of nmols")
        names = tuple(group_names or ())
        groups: tuple[tuple[int, ...], ...] = ()
        if group_atom_indices is not None:
            groups = tuple(tuple(sorted(int(i) for i in g)) for g in group_atom_indices)
            if any(list(g) != sorted(set(g)) for g in groups):
                raise ValueError("an atom is repeated within a group")
            if not set().union(*map(set, groups)) <= set(indices):
                raise ValueError("a group has an atom that is not in the selection")
            if any(tuple(map(int, g)) != s for g, s in zip(group_atom_indices, groups, strict=True)):
                warnings.warn("the atoms of a group were not sorted", stacklevel=2)
            if not names:
                warnings.warn("the groups have no names", stacklevel=2)
                names = tuple(f"group_{k + 1}" for k in range(len(groups)))
            if len(names) != len(groups):
                raise ValueError("as many group names as groups are needed")
        elif names and len(names) != len(indices) // nmols:
            raise ValueError("as many group names as atoms of a molecule are needed")
        return cls(indices, nmols, len(indices) // nmols, names, groups)

    @classmethod
    def of(cls, atoms: DataFrame, **options) -> AtomSelection:
        """From an atom table (a structure, not a trajectory); by default the groups are named by the atoms."""
        rows = atoms.select("atom_index", "name").orderBy("atom_index").collect()
        made = cls.make([r.atom_index for r in rows], **options)
        if made.group_names:
            return made
        return cls(made.indices, made.nmols, made.natomspermol, tuple(r.name for r in rows[: made.natomspermol]))

    @property
    def custom_groups(self) -> bool:
        return bool(self.group_atom_indices)

    @property
    def n_groups(self) -> int:
        return len(self.group_atom_indices) if self.custom_groups else self.natomspermol

    def natoms(self) -> int:
        return len(self.indices)

    def atom_group(self, which: int | str) -> tuple[int, ...]:
        """The atoms of a custom group, by number from 1 or by name."""
        if not self.custom_groups:
            raise ValueError("the selection has no custom groups")
        if isinstance(which, str):
            if which not in self.group_names:
                raise ValueError(f"there is no group {which!r}")
            which = self.group_names.index(which) + 1
        if not 1 <= which <= len(self.group_atom_indices):
            raise ValueError(f"there is no group {which}")
        return self.group_atom_indices[which - 1]

    def atom_group_name(self, which: int) -> str:
        return self.group_names[which - 1]

    def atom_group_names(self) -> tuple[str, ...]:
        return self.group_names

    def types(self, indices) -> list[int]:
        """Each atom's number within its molecule."""
        place = {i: k for k, i in enumerate(self.indices)}
        if any(i not in place for i in indices):
            raise ValueError("an atom of the group is not in the selection")
        return [place[i] % self.natomspermol + 1 for i in indices]

    def table(self, spark) -> DataFrame:
        """pos, atom_index, mol and atype of each atom."""
        n = self.natomspermol
        rows = [(k + 1, i, k // n + 1, k % n + 1) for k, i in enumerate(self.indices)]
        return spark.createDataFrame(rows, "pos int, atom_index int, mol int, atype int")

    def groups(self, spark) -> DataFrame:
        """group_id, group_name and atom_index."""
        if self.custom_groups:
            rows = [(k, name, i) for k, (name, own) in enumerate(zip(self.group_names, self.group_atom_indices, strict=True), 1) for i in own]
        else:
            n = self.natomspermol
            rows = [(k % n + 1, self.group_names[k % n] if self.group_names else str(k % n + 1), i) for k, i in enumerate(self.indices)]
        return spark.createDataFrame(rows, "group_id int, group_name string, atom_index int")

    def __str__(self) -> str:
        plural = lambda n, what: f"{n} {what}" + "s" * (n != 1)
        return f"AtomSelection: {plural(self.natoms(), 'atom')} of {plural(self.nmols, 'molecule')}, {plural(self.n_groups, 'group')}"


@dataclass(frozen=True)
class TableSelection:
    """A selection of any size: its atoms (atom, and with custom groups group_id and group_name) stay in a table, only names and counts are here."""

    atoms: DataFrame
    nmols: int
    natomspermol: int
    group_names: tuple[str, ...]
    custom_groups: bool

    @classmethod
    def make(cls, atoms: DataFrame, natomspermol: int, group_names=None) -> TableSelection:
        """The groups are the atoms of a molecule, named in order; without names they are those of the table."""
        n = atoms.select("atom").distinct().count()
        if not n:
            raise ValueError("the selection has no atoms")
        if n % natomspermol:
            raise ValueError("the number of atoms is not a multiple of natomspermol")
        if group_names is not None:
            if len(group_names) != natomspermol:
                raise ValueError("as many group names as atoms of a molecule are needed")
            return cls(atoms, n // natomspermol, natomspermol, tuple(group_names), False)
        names = {r.group_id: r.group_name for r in atoms.select("group_id", "group_name").distinct().collect()}  # a row for each group
        return cls(atoms, n // natomspermol, natomspermol, tuple(names.get(k, str(k)) for k in range(1, max(names) + 1)), True)

    @property
    def n_groups(self) -> int:
        return len(self.group_names)

    def natoms(self) -> int:
        return self.nmols * self.natomspermol

    def atom_group(self, which: int | str) -> DataFrame:
        """The atoms of a custom group, by number from 1 or by name."""
        if not self.custom_groups:
            raise ValueError("the selection has no custom groups")
        if isinstance(which, str):
            if which not in self.group_names:
                raise ValueError(f"there is no group {which!r}")
            which = self.group_names.index(which) + 1
        if not 1 <= which <= self.n_groups:
            raise ValueError(f"there is no group {which}")
        return self.atoms.where(F.col("group_id") == which).select("atom")

    def atom_group_names(self) -> tuple[str, ...]:
        return self.group_names

    def types(self, indices) -> list[int]:
        """Each atom's number within its molecule; of a few atoms, by how many are before them."""
        indices = list(indices)
        each = self.atoms.select("atom").distinct()
        here = [F.max((F.col("atom") == i).cast("int")).alias(f"here{k}") for k, i in enumerate(indices)]
        before = [F.sum((F.col("atom") < i).cast("long")).alias(f"before{k}") for k, i in enumerate(indices)]
        r = each.agg(*here, *before).first()
        if any(not r[f"here{k}"] for k in range(len(indices))):
            raise ValueError("an atom of the group is not in the selection")
        return [r[f"before{k}"] % self.natomspermol + 1 for k in range(len(indices))]


def molecule_index(atoms: DataFrame, natomspermol: int, order: str = "atom_index") -> DataFrame:
    """Position, molecule and atom type of selected atoms within a table of any size, numbered by ``order``.

    Ranges of the order are sorted and numbered by separate tasks; only the ranges' sizes meet.
    """
    sorted_ = atoms.repartitionByRange(order).sortWithinPartitions(order).withColumn("pos", F.monotonically_increasing_id())
    rows = settled(sorted_, "molecules")
    part, place = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for k, n in sizes:
        offsets.append((k, before))
        before += n
    starts = F.broadcast(atoms.sparkSession.createDataFrame(offsets, "part long, before long"))  # one row a task
    out = rows.withColumn("part", part).join(starts, "part").withColumn("pos", (F.col("before") + place + 1).cast("long")).drop("part", "before")
    return out.withColumns({"mol": F.floor((F.col("pos") - 1) / natomspermol).cast("int") + 1, "atype": F.pmod(F.col("pos") - 1, F.lit(natomspermol)) + 1})


@dataclass(frozen=True)
class Group:
    """One side's atoms: exactly one of a group number, a group name, atom indices or atom names."""

    side: str
    index: int | None = None
    name: str | None = None
    atom_indices: tuple[int, ...] | None = None
    atom_names: tuple[str, ...] | None = None
    _: None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        given = [x for x in (self.index, self.name, self.atom_indices, self.atom_names) if x is not None]
        if len(given) != 1:
            raise TypeError("a group is one of a group number, a group name, atom indices or atom names")
        for own in (self.atom_indices, self.atom_names):
            if own is not None and (not own or len(set(own)) != len(own)):
                raise ValueError("a group needs atoms, each of them once")

    @classmethod
    def make(cls, side: str, what) -> Group:
        if isinstance(what, str):
            return cls(side, name=what)
        if isinstance(what, bool) or what is None:
            raise TypeError(f"not a group: {what!r}")
        if isinstance(what, int):
            return cls(side, index=what)
        if isinstance(what, DataFrame):
            return cls(side, atom_indices=tuple(r.atom_index for r in what.select("atom_index").orderBy("atom_index").collect()))
        own = tuple(what)
        if own and all(isinstance(x, str) for x in own):
            return cls(side, atom_names=own)
        return cls(side, atom_indices=tuple(int(x) for x in own))


def SoluteGroup(what) -> Group:  # noqa: N802
    return Group.make("solute", what)


def SolventGroup(what) -> Group:  # noqa: N802
    return Group.make("solvent", what)
