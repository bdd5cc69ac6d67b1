"""The classic binary layout of gridded files (64-bit offsets): headers of named dimensions, attributes and variables, big-endian arrays."""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import numpy as np

#: Types by their numbers, and the numbers of the header's lists (fixed values of the format).
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
_NUMBER = {np.dtype(t): k for k, t in TYPES.items()}


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: np.dtype
    begin: int
    attrs: dict[str, Any] = field(default_factory=dict)


def _room(n: int) -> int:
    return n + -n % 4


class ClassicReader:
    """The header of an open file; arrays are read by rows."""

    def __init__(self, f: BinaryIO):
        self.f = f
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError("not a file of the classic layout")
        self.wide = magic[3] == 2
        self._int()  # the number of records; only the first is read
        names = [(self._name(), self._int()) for _ in range(self._list(_DIMENSIONS))]
        self.dims = dict(names)
        self.attrs = self._attributes()
        self.variables: dict[str, Variable] = {}
        for _ in range(self._list(_VARIABLES)):
            name = self._name()
            own = [names[self._int()] for _ in range(self._int())]
            attrs, kind = self._attributes(), np.dtype(TYPES[self._int()])
            self._int()  # the size, which follows from the shape
            begin = struct.unpack(">q", f.read(8))[0] if self.wide else self._int()
            self.variables[name] = Variable(name, tuple(d for d, _ in own), tuple(n or 1 for _, n in own), kind, begin, attrs)

    def _int(self) -> int:
        data = self.f.read(4)
        if len(data) < 4:
            raise ValueError("the file ends within its header")
        return struct.unpack(">i", data)[0]

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._int()
        if found not in (tag, 0):
            raise ValueError("not a file of the classic layout")
        return n

    def _name(self) -> str:
        n = self._int()
        return self.f.read(_room(n))[:n].decode("utf-8")

    def _attributes(self) -> dict[str, Any]:
        out = {}
        for _ in range(self._list(_ATTRIBUTES)):
            name, kind, n = self._name(), np.dtype(TYPES[self._int()]), self._int()
            data = self.f.read(_room(n * kind.itemsize))[: n * kind.itemsize]
            out[name] = data.decode("utf-8") if kind.kind == "S" else np.frombuffer(data, kind)[0].item() if n == 1 else np.frombuffer(data, kind)
        return out

    def rows(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Rows ``lo`` to ``hi`` (included) of the last two dimensions, at the first index of all others; nothing else is read."""
        v = self.variables[name]
        ny, nx = (1, 1, *v.shape)[-2:]
        lo, hi = max(0, lo), min(ny - 1, ny - 1 if hi is None else hi)
        n = max(0, hi - lo + 1) * nx
        self.f.seek(v.begin + lo * nx * v.dtype.itemsize)
        data = self.f.read(n * v.dtype.itemsize)
        if len(data) < n * v.dtype.itemsize:
            raise ValueError(f"the file ends within {name}")
        return np.frombuffer(data, v.dtype).reshape(-1, nx)

    def decoded(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """``rows`` as doubles, scaled, with NaN for the fill and missing values."""
        raw, attrs = self.rows(name, lo, hi), self.variables[name].attrs
        out = raw.astype(float) * attrs.get("scale_factor", 1.0) + attrs.get("add_offset", 0.0)
        for k in ("_FillValue", "missing_value"):
            if k in attrs:
                out[raw == attrs[k]] = np.nan
        return out


def write_classic(f: BinaryIO, dims: Mapping[str, int | None], variables: Sequence[tuple[str, Sequence[str], np.ndarray, Mapping[str, Any]]], attrs: Mapping[str, Any]) -> None:
    """Write a file whose dimension without a length, if there is one, is open and holds one record."""
    order = list(dims)
    is_open = [any(dims[d] is None for d in names) for _, names, _, _ in variables]
    variables = [v for k in (False, True) for v, o in zip(variables, is_open, strict=True) if o is k]  # records lie behind the rest

    def text(s: str) -> bytes:
        data = s.encode("utf-8")
        return struct.pack(">i", len(data)) + data.ljust(_room(len(data)), b"\0")

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def attributes(own: Mapping[str, Any]) -> bytes:
        items = []
        for k, v in own.items():
            if isinstance(v, str):
                data = v.encode("utf-8")
                items.append(text(k) + struct.pack(">ii", 2, len(data)) + data.ljust(_room(len(data)), b"\0"))
            else:
                a = np.atleast_1d(v)
                a = a.astype(a.dtype.newbyteorder(">"))
                items.append(text(k) + struct.pack(">ii", _NUMBER[a.dtype], a.size) + a.tobytes().ljust(_room(a.nbytes), b"\0"))
        return listed(_ATTRIBUTES, items)

    arrays = [np.ascontiguousarray(a, a.dtype.newbyteorder(">")) for _, _, a, _ in variables]
    records = int(any(n is None for n in dims.values()))
    head = b"CDF\2" + struct.pack(">i", records) + listed(_DIMENSIONS, [text(d) + struct.pack(">i", n or 0) for d, n in dims.items()]) + attributes(attrs)
    entries = []
    for (name, names, _, own), a in zip(variables, arrays, strict=True):
        ids = struct.pack(f">i{len(names)}i", len(names), *map(order.index, names))
        entries.append(text(name) + ids + attributes(own) + struct.pack(">ii", _NUMBER[a.dtype], min(_room(a.nbytes), 2**31 - 1)))
    at = len(head) + 8 + sum(len(e) + 8 for e in entries)
    placed = []
    for e, a in zip(entries, arrays, strict=True):
        placed.append(e + struct.pack(">q", at))
        at += _room(a.nbytes)
    f.write(head + listed(_VARIABLES, placed))
    for a in arrays:
        f.write(a.tobytes())
        f.write(b"\0" * (_room(a.nbytes) - a.nbytes))
