"""Keyword layouts and what keywords define.

The layouts below are those of a starter set; ``Library.register`` adds others, from classes
declared with ``keyword`` or from a JSON description given at run time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from deckframe.functions.text import canonical_base

INT, FLOAT, STR = "int", "float", "str"


@dataclass(frozen=True)
class Field:
    """A column range: name, type, width, how often it repeats, and the kinds its id may refer to."""

    name: str
    type: str = INT
    width: int = 10
    count: int = 1
    refs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Card:
    fields: tuple[Field, ...]

    @property
    def widths(self) -> list[int]:
        return [f.width for f in self.fields for _ in range(f.count)]


@dataclass(frozen=True)
class Schema:
    """A keyword's cards; with ``repeat`` the group of cards repeats to the block's end."""

    keyword: str
    cards: tuple[Card, ...]
    repeat: bool = True

    def columns(self) -> list[tuple[str, Field]]:
        """(column name, field), names made unique by _2, _3 and so on."""
        seen: dict[str, int] = {}
        out = []
        for f in (f for c in self.cards for f in c.fields):
            seen[f.name] = n = seen.get(f.name, 0) + 1
            out.append((f.name if n == 1 else f"{f.name}_{n}", f))
        return out


@dataclass(frozen=True)
class Definition:
    """What a keyword defines: the kind, whether by every line, and which card's first field is the id."""

    kind: str
    per_line: bool = False
    card: int = 0


#: Fixed value: kinds by exact keyword name.
_EXACT = {
    "NODE": Definition("Node", True), "PART": Definition("Part", False, 1), "HOURGLASS": Definition("Hourglass"),
    "COMPONENT_GEBOD_MALE": Definition("Define"), "COMPONENT_GEBOD_FEMALE": Definition("Define"),
    "COMPONENT_GEBOD_CHILD": Definition("Define"), "COMPONENT_HYBRIDIII": Definition("Define"),
}
#: Fixed value: kinds by the beginning of the name; of several that fit the longest holds.
_PREFIX = {
    "ELEMENT_": Definition("Element", True), "MAT_THERMAL": Definition("ThermalMaterial"), "MAT_": Definition("Material"),
    "SECTION_": Definition("Section"), "EOS_": Definition("Eos"), "DEFINE_CURVE": Definition("Curve"), "DEFINE_TABLE": Definition("Curve"),
    "DEFINE_FUNCTION": Definition("Curve"), "DEFINE_COORDINATE": Definition("Coord"), "DEFINE_VECTOR": Definition("Vector"),
    "DEFINE_BOX": Definition("Box"), "DEFINE_TRANSFORM": Definition("Transform"), "SET_NODE": Definition("NodeSet"),
    "SET_PART": Definition("PartSet"), "SET_SEGMENT": Definition("SegmentSet"), "SET_SHELL": Definition("ShellSet"),
    "SET_SOLID": Definition("SolidSet"), "SET_BEAM": Definition("BeamSet"), "SET_DISCRETE": Definition("DiscreteSet"),
    "SENSOR_DEFINE": Definition("Sensor"),
}


def is_modifier(base: str) -> bool:
    """Keywords that change an entity instead of defining one."""
    return base.startswith(("MAT_ADD", "MAT_CHANGE")) or "_ADD_" in base


def definition_of(base: str) -> Definition | None:
    if is_modifier(base):
        return None
    fits = [p for p in _PREFIX if base.startswith(p)]
    return _EXACT.get(base) or (_PREFIX[max(fits, key=len)] if fits else None)


def _card(spec: str, width: int = 10) -> Card:
    """Fields from a short text: ``name[:type][:width][>Kind|Kind]``, separated by blanks; i, f and s are the types."""
    out = []
    for item in spec.split():
        head, _, refs = item.partition(">")
        name, *rest = head.split(":")
        kind = {"i": INT, "f": FLOAT, "s": STR}[next((r for r in rest if r.isalpha()), "i")]
        w = next((int(r) for r in rest if r.isdigit()), width)
        out.append(Field(name, kind, w, refs=tuple(refs.split("|")) if refs else ()))
    return Card(tuple(out))


def _layout(name: str, *cards: str, width: int = 10) -> Schema:
    return Schema(name, tuple(_card(c, width) for c in cards))


_DOF = "dofx dofy dofz dofrx dofry dofrz"
_EIGHT = " ".join(f"{{0}}{k}" + "{1}" for k in range(1, 9))
#: Fixed value: the starter set of layouts.
STARTER = [
    _layout("NODE", "nid:8 x:f:16 y:f:16 z:f:16 tc:8 rc:8"),
    _layout("PART", "heading:s:80", "pid secid>Section mid>Material eosid>Eos hgid>Hourglass grav adpopt tmid>ThermalMaterial"),
    _layout("ELEMENT_SHELL", "eid pid>Part " + _EIGHT.format("n", ">Node"), width=8),
    _layout("ELEMENT_SOLID", "eid pid>Part " + _EIGHT.format("n", ">Node"), width=8),
    _layout("ELEMENT_BEAM", "eid pid>Part n1>Node n2>Node n3>Node rt1 rr1 rt2 rr2 local", width=8),
    _layout("MAT_ELASTIC", "mid ro:f e:f pr:f da:f db:f not:i"),
    _layout("MAT_PLASTIC_KINEMATIC", "mid ro:f e:f pr:f sigy:f etan:f beta:f", "src:f srp:f fs:f vp:f"),
    _layout("MAT_SPOTWELD", "mid ro:f e:f pr:f sigy:f eh:f dt:f tfail:f", "efail:f nrr:f nrs:f nrt:f mrr:f mss:f mtt:f nf:f"),
    _layout("MAT_RIGID", "mid ro:f e:f pr:f n:f couple:f m:f alias:s"),
    _layout("SECTION_SOLID", "secid elform aet"),
    _layout("SECTION_SHELL", "secid elform shrf:f nip propt:f qr irid icomp setyp", "t1:f t2:f t3:f t4:f nloc:f marea:f idof:f edgset"),
    _layout("SECTION_BEAM", "secid elform shrf:f qr cst scoor:f nsm:f", "ts1:f ts2:f tt1:f tt2:f print:f"),
    _layout("DEFINE_CURVE", "lcid sidr sfa:f sfo:f offa:f offo:f dattyp lcint", "a1:f:20 o1:f:20"),
    _layout("SET_PART_LIST", "sid da1:f da2:f da3:f da4:f solver:s", _EIGHT.format("pid", ">Part")),
    _layout("SET_NODE_LIST", "sid da1:f da2:f da3:f da4:f solver:s", _EIGHT.format("nid", ">Node")),
    _layout("SET_BEAM", "sid", _EIGHT.format("k", ">Element")),
    _layout("BOUNDARY_SPC_NODE", f"nid>Node cid>Coord {_DOF}"),
    _layout("BOUNDARY_SPC_SET", f"nsid>NodeSet cid>Coord {_DOF}"),
    _layout("BOUNDARY_PRESCRIBED_MOTION_SET", "nsid>NodeSet dof vad lcid>Curve sf:f vid>Vector death:f birth:f"),
    _layout("BOUNDARY_PRESCRIBED_MOTION_RIGID", "pid>Part dof vad lcid>Curve sf:f vid>Vector death:f birth:f"),
    _layout("INITIAL_AXIAL_FORCE_BEAM", "bsid>BeamSet lcid>Curve scale:f kbend"),
    _layout("CONSTRAINED_NODAL_RIGID_BODY", "pid cid>Coord nsid>NodeSet pnode iprt drflag rrflag"),
    _layout("LOAD_RIGID_BODY", "pid>Part dof lcid>Curve sf:f cid>Coord m1 m2 m3"),
    _layout("CONSTRAINED_RIGID_BODIES", "pidl>Part pidc>Part iflag"),
    _layout("CONSTRAINED_EXTRA_NODES_NODE", "pid>Part nid>Node iflag"),
    _layout("CONSTRAINED_EXTRA_NODES_SET", "pid>Part nsid>NodeSet iflag"),
    _layout("CONSTRAINED_RIGID_BODY_STOPPERS", "pid>Part lcmax lcmin psidmx psidmn lcvmnx dir vid"),
    _layout("SENSOR_DEFINE_NODE", "sensid node1>Node node2>Node vid>Vector ctype:s"),
    _layout("SENSOR_SWITCH", "switid type:s sensid>Sensor logic:s value:f"),
    _layout("CONTROL_TERMINATION", "endtim:f endcyc dtmin:f endeng:f endmas:f nosol"),
    _layout("CONTROL_TIMESTEP", "dtinit:f tssfac:f isdo tslimt:f dt2ms:f lctm erode ms1st"),
    _layout("DATABASE_BINARY_D3PLOT", "dt:f lcdt beam npltc psetid"),
    _layout("INCLUDE_TRANSFORM", "filename:s:80", "idnoff ideoff idpoff idmoff idsoff idfoff iddoff", "idroff"),
]

#: Fixed value: the first words of keyword names. Any name that begins with one is known, with or without a layout here.
FAMILIES = (
    "AIRBAG ALE BATTERY BOUNDARY CASE CESE CHANGE CHEMISTRY COMMENT COMPONENT CONSTRAINED CONTACT CONTROL CONTROLLER COSIM DAMPING DATABASE DEFINE DEFORMABLE DELETE DUALCESE EF ELEMENT EM EOS "
    "FATIGUE FREQUENCY HOURGLASS ICFD IGA INCLUDE INITIAL INTEGRATION INTERFACE KEYWORD LOAD LSO MAT MESH MODULE NODE PARAMETER PART PARTICLE PERTURBATION RAIL RIGID RIGIDWALL RVE SECTION SENSOR SET"
).split()


def is_known(name: str) -> bool:
    """Whether a name is one of a keyword: a family, then words of capitals and digits."""
    words = canonical_base(name).split("_")
    return words[0] in FAMILIES and all(w.isascii() and w.replace("-", "").isalnum() for w in words)


class _Names:
    """Names of keywords as attributes: ``Names.MAT_ELASTIC`` is that text; a name of no family is an AttributeError."""

    def __getattr__(self, name: str) -> str:
        if name != name.upper() or not is_known(name):
            raise AttributeError(f"no keyword is called {name}")
        return name

    def __dir__(self) -> list[str]:
        return [s.keyword for s in STARTER]


Names = _Names()

#: Fixed value: codes by which run-time descriptions name what a field refers to.
LINK_KINDS = {
    1: ("Node",), 3: ("Element",), 4: ("Element",), 5: ("Element",), 6: ("Element",), 13: ("Part",), 14: ("Material",), 15: ("Section",),
    16: ("Eos",), 17: ("Hourglass",), 19: ("Curve",), 20: ("Box",), 21: ("Coord",), 22: ("Vector",), 23: ("Vector",), 27: ("NodeSet",),
    28: ("PartSet",), 29: ("SegmentSet",), 37: ("Define",), 38: ("Define",), 40: ("Transform",), 44: ("ThermalMaterial",), 55: ("Sensor",),
    66: ("Part",), 69: ("Part",), 77: ("Curve",), 86: ("Curve",), 110: ("Curve",), -2: ("SegmentSet", "NodeSet", "PartSet"),
}


@dataclass
class Library:
    """Layouts by canonical name. Registered ones win over the starter set and replace each other."""

    own: dict[str, Schema] = field(default_factory=dict)
    starter: dict[str, Schema] = field(default_factory=lambda: {s.keyword: s for s in STARTER})

    def find(self, name: str) -> Schema | None:
        """The layout of a keyword, by its base or else its exact name."""
        base = canonical_base(name)
        return self.own.get(base) or self.starter.get(base)

    def all(self) -> list[Schema]:
        """Every layout that may be found."""
        return list((self.starter | self.own).values())

    def register(self, schema: Schema) -> None:
        self.own[canonical_base(schema.keyword)] = schema

    def names(self) -> list[str]:
        return sorted({**self.starter, **self.own})

    def load_json(self, text: str, links: dict[int, tuple[str, ...]] | None = None) -> None:
        """Registers layouts from JSON: {keyword: [[{name, type, width, link}, ...], ...]}; types as in ``integer``, ``real``, ``string``."""
        links = links or LINK_KINDS
        for name, cards in json.loads(text).items():
            made = tuple(Card(tuple(
                Field(f["name"].lower(), {"integer": INT, "string": STR}.get(f["type"], FLOAT), int(f["width"]), refs=links.get(f.get("link"), ())) for f in c
            )) for c in cards)
            self.register(Schema(name.upper(), made))


def keyword(name: str, repeat: bool = True):  # noqa: ANN201
    """Class decorator: annotated attributes become fields, as in ``nid: int = col(8)``.

    A class with ``cards = [A, B]`` takes its cards from other classes so declared.
    """
    def made(cls: type) -> type:
        parts = getattr(cls, "cards", None) or [cls]
        types = {int: INT, float: FLOAT, str: STR, "int": INT, "float": FLOAT, "str": STR}
        cards = []
        for p in parts:
            fields = []
            for attr, annotation in getattr(p, "__annotations__", {}).items():
                spec = getattr(p, attr, None)
                if isinstance(spec, Field):
                    fields.append(replace(spec, name=attr, type=types[annotation]))
            cards.append(Card(tuple(fields)))
        cls.schema = Schema(name, tuple(cards), repeat)
        return cls

    return made


def col(width: int = 10, count: int = 1, ref: str | Sequence[str] = ()) -> Field:
    """A field's width, repetition and reference, for ``keyword`` classes."""
    return Field("", INT, width, count, (ref,) if isinstance(ref, str) else tuple(ref))


def schema(name: str, cards: Iterable[Iterable[Field]], repeat: bool = True) -> Schema:
    return Schema(name, tuple(Card(tuple(c)) for c in cards), repeat)
