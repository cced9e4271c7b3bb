"""Headers on the driver and in readers: cards of 80 bytes, in order, first match wins."""

from __future__ import annotations

import dataclasses
import re

from .. import errors

BLOCK, CARD = 2880, 80
#: Limits against hostile files.
LIMITS = {"header_blocks": 1 << 14, "hdus": 100_000, "pixels": 1 << 40, "heap": 1 << 34, "vla": 1 << 30, "string": 1 << 20, "tile": 1 << 30, "allocation": 1 << 32}
_VALUE = re.compile(r"^ *(?:'((?:[^']|'')*)'|([^/]*?)) *(?:/ ?(.*))?$", re.S)


@dataclasses.dataclass
class Card:
    """One card; value is a str, bool, int, float, complex or None."""

    name: str
    kind: str
    raw: str
    value: object = None
    comment: str | None = None

    @classmethod
    def parse(cls, raw: str) -> Card:
        if len(raw) != CARD or any(not " " <= c <= "~" for c in raw):
            raise errors.BadCard(repr(raw))
        name = raw[:8].rstrip().upper()
        if re.search(r"[^A-Z0-9_-]", name):
            raise errors.BadCard(repr(raw))
        if name == "END":
            return cls(name, "end", raw)
        if name == "CONTINUE":
            value, comment = parse_value(raw[10:])
            return cls(name, "continue", raw, value if isinstance(value, str) else None, comment)
        if name == "HIERARCH" and "=" in raw:
            value, comment = parse_value(raw[raw.index("=") + 1 :])
            return cls(" ".join(raw[8 : raw.index("=")].split()), "hierarch", raw, value, comment)
        if name in ("COMMENT", "HISTORY", "") or raw[8:10] != "= ":
            return cls(name, "commentary" if name else "blank", raw, raw[8:].rstrip())
        value, comment = parse_value(raw[10:])
        return cls(name, "value", raw, value, comment)


def parse_value(field: str) -> tuple[object, str | None]:
    """The value and the comment of a value field."""
    m = _VALUE.match(field)
    if not m:
        raise errors.BadValue(field)
    comment = m[3].rstrip() if m[3] is not None else None
    if m[1] is not None:
        inner = m[1].replace("''", "'")
        return (inner.rstrip(" ") or (" " if inner else "")), comment
    t = (m[2] or "").strip()
    if not t:
        return None, comment
    if t in ("T", "F"):
        return t == "T", comment
    if t.startswith("(") and t.endswith(")"):
        try:
            re_, im = (number(x.strip()) for x in t[1:-1].split(","))
        except ValueError:
            raise errors.BadValue(field) from None
        return complex(re_, im), comment
    return number(t), comment


def number(t: str):
    """An int if it has only digits and fits 64 bits, else a finite float."""
    if re.fullmatch(r"[+-]?\d+", t) and -(1 << 63) <= int(t) < 1 << 63:
        return int(t)
    if not re.fullmatch(r"[0-9+\-.EeDd]+", t):
        raise errors.BadValue(t)
    try:
        x = float(t.replace("D", "E").replace("d", "e"))
    except ValueError:
        raise errors.BadValue(t) from None
    if x in (float("inf"), float("-inf")):
        raise errors.BadValue(t)
    return x


class Header:
    """Ordered cards with typed lookup."""

    def __init__(self, cards: list[Card]):
        self.cards = cards
        self.first: dict[str, Card] = {}
        for i, c in enumerate(cards):
            if c.kind in ("value", "hierarch"):
                self.first.setdefault(c.name, self._whole(i))

    def _whole(self, i: int) -> Card:
        """A card with what CONTINUE cards add to its text."""
        c, j = self.cards[i], i + 1
        text, notes = c.value, [c.comment]
        while isinstance(text, str) and text.endswith("&") and j < len(self.cards) and self.cards[j].kind == "continue" and isinstance(self.cards[j].value, str):
            text = text[:-1] + self.cards[j].value
            notes.append(self.cards[j].comment)
            j += 1
        return dataclasses.replace(c, value=text, comment=" ".join(n for n in notes if n) or None) if j > i + 1 else c

    @classmethod
    def read(cls, f, at: int) -> tuple[Header, int]:
        """The header at a place of a file, and where the data begin."""
        cards: list[Card] = []
        for n in range(LIMITS["header_blocks"]):
            f.seek(at + n * BLOCK)
            block = f.read(BLOCK)
            if len(block) < BLOCK:
                raise errors.MissingEnd(f"byte {at}")
            for k in range(0, BLOCK, CARD):
                card = Card.parse(block[k : k + CARD].decode("latin-1"))
                if card.kind == "end":
                    return cls(cards), at + (n + 1) * BLOCK
                cards.append(card)
        raise errors.LimitExceeded("header blocks")

    def find(self, pattern: str, most: int = 4096) -> tuple[list[Card], bool]:
        """The cards whose names fit a pattern (* any run, ? one character, # digits), and whether there were more than ``most``."""
        own = {"*": ".*", "?": ".", "#": "[0-9]+"}
        form = re.compile("".join(own.get(c, re.escape(c)) for c in pattern.removeprefix("HIERARCH ")), re.I)
        found = [c for c in self.cards if form.fullmatch(c.name)]
        return found[:most], len(found) > most

    def typed(self, name: str, kind: type):
        """The value as bool, int, float, complex or str; ints read as floats, and whole floats as ints.

        A keyword that is missing, one without a value and one of another type are three errors.
        """
        if name not in self.first:
            raise errors.KeywordNotFound(name)
        v = self.first[name].value
        if v is None:
            raise errors.ValueUndefined(name)
        if kind in (int, float) and isinstance(v, (int, float)) and not isinstance(v, bool):
            if kind is int and isinstance(v, float):
                if v != round(v) or not -(1 << 63) <= v < 1 << 63:
                    raise errors.WrongValueType(name)
                return int(v)
            return kind(v)
        if kind is complex and isinstance(v, (int, float)) and not isinstance(v, bool):
            return complex(v)
        if type(v) is not kind:
            raise errors.WrongValueType(name)
        return v

    def comment(self, name: str) -> str | None:
        """The comment of a keyword."""
        if name not in self.first:
            raise errors.KeywordNotFound(name)
        return self.first[name].comment

    def unit(self, name: str) -> str | None:
        """What stands in brackets at the beginning of a comment."""
        found = re.match(r"\[([^\]]*)\]", self.comment(name) or "")
        return found[1] if found else None

    def _texts(self, name: str) -> list[str]:
        return [c.raw[8:].rstrip() for c in self.cards if c.name == name and c.kind != "value"]

    @property
    def comments(self) -> list[str]:
        """The texts of COMMENT cards."""
        return self._texts("COMMENT")

    @property
    def history(self) -> list[str]:
        """The texts of HISTORY cards."""
        return self._texts("HISTORY")

    # A header is an ordered mapping of keywords to values too.

    def __getitem__(self, name: str):
        if name not in self.first:
            raise errors.KeywordNotFound(name)
        return self.first[name].value

    def __contains__(self, name: str) -> bool:
        return name in self.first

    def __iter__(self):
        return iter(self.first)

    def __len__(self) -> int:
        return len(self.first)

    def keys(self):
        return self.first.keys()

    def items(self):
        return [(k, c.value) for k, c in self.first.items()]

    def __setitem__(self, name: str, value) -> None:
        """Replace or add a keyword; (value, comment) changes the comment too.  A new one fills the first blank card."""
        from .fits_sink import card

        new = value if isinstance(value, tuple) else (value, self.first[name].comment if name in self.first else None)
        data = card(name, *new).decode("latin-1")
        made = [Card.parse(data[a : a + CARD]) for a in range(0, len(data), CARD)]
        at = next((i for i, c in enumerate(self.cards) if c.name == name and c.kind in ("value", "hierarch")), None)
        if at is not None:
            self._replace(at, self._end(at), made)
        else:
            at = next((i for i, c in enumerate(self.cards) if c.kind == "blank" and not c.raw.strip()), None)
            self._replace(len(self.cards) if at is None else at, len(self.cards) if at is None else at + 1, made)

    def __delitem__(self, name: str) -> None:
        if name not in self.first:
            raise errors.KeywordNotFound(name)
        at = next(i for i, c in enumerate(self.cards) if c.name == name and c.kind in ("value", "hierarch"))
        self._replace(at, self._end(at), [])

    def add_comment(self, text: str, name: str = "COMMENT") -> None:
        """One more COMMENT or, by name, HISTORY card, or several for a long text."""
        from .fits_sink import card

        data = card(name, text).decode("latin-1")
        self._replace(len(self.cards), len(self.cards), [Card.parse(data[a : a + CARD]) for a in range(0, len(data), CARD)])

    def add_history(self, text: str) -> None:
        self.add_comment(text, "HISTORY")

    def _end(self, at: int) -> int:
        """Where the cards that go on with a card end."""
        end = at + 1
        while end < len(self.cards) and self.cards[end].kind == "continue":
            end += 1
        return end

    def _replace(self, first: int, end: int, made: list[Card]) -> None:
        self.__init__([*self.cards[:first], *made, *self.cards[end:]])

    def to_bytes(self) -> bytes:
        """The header as whole blocks."""
        data = b"".join(c.raw.encode("latin-1") for c in self.cards) + b"END".ljust(CARD)
        return data + b" " * (-len(data) % BLOCK)

    def value(self, name: str, default=None):
        c = self.first.get(name)
        return default if c is None or c.value is None else c.value

    def has(self, name: str) -> bool:
        return name in self.first

    def integer(self, name: str, default: int | None = None) -> int:
        v = self.value(name, default)
        if isinstance(v, bool) or not isinstance(v, int):
            raise errors.MissingRequiredKeyword(name) if v is None else errors.WrongValueType(name)
        return v

    def real(self, name: str, default: float | None = None) -> float:
        v = self.value(name, default)
        if v is None:
            raise errors.KeywordNotFound(name)
        if isinstance(v, (bool, str, complex)):
            raise errors.WrongValueType(name)
        return float(v)

    def text(self, name: str, default: str | None = None) -> str | None:
        v = self.value(name, default)
        return v.rstrip() if isinstance(v, str) else default


@dataclasses.dataclass
class Hdu:
    """Where an HDU stands and what it holds."""

    number: int
    header: Header
    at: int
    data_at: int
    kind: str
    bitpix: int
    axes: list[int]
    pcount: int
    gcount: int

    @property
    def data_bytes(self) -> int:
        axes = self.axes[1:] if self.kind == "random_groups" else self.axes
        if not self.axes:
            return 0
        size = 1
        for n in axes:
            size *= n
        total = abs(self.bitpix) // 8 * self.gcount * (self.pcount + size)
        if total >= 1 << 63:
            raise errors.LimitExceeded("the data unit's size")
        return total

    @property
    def end(self) -> int:
        return self.data_at + -(-self.data_bytes // BLOCK) * BLOCK

    @property
    def extname(self) -> str | None:
        return self.header.text("EXTNAME")

    @property
    def extver(self) -> int:
        v = self.header.value("EXTVER", 1)
        return v if isinstance(v, int) else 1

    @property
    def compressed(self) -> bool:
        return self.kind == "binary_table" and self.header.value("ZIMAGE") is True


def make_hdu(number_: int, header: Header, at: int, data_at: int) -> Hdu:
    """The HDU of a header; structural errors are raised."""
    c = header.cards
    first = c[0].name if c else ""
    if first not in ("SIMPLE", "XTENSION") or (number_ == 1) != (first == "SIMPLE"):
        raise errors.MissingRequiredKeyword("SIMPLE" if number_ == 1 else "XTENSION")
    if [x.name for x in c[1:3]] != ["BITPIX", "NAXIS"]:
        raise errors.MissingRequiredKeyword("BITPIX and NAXIS")
    bitpix, naxis = header.integer("BITPIX"), header.integer("NAXIS")
    if bitpix not in (8, 16, 32, 64, -32, -64):
        raise errors.BadBitpix(str(bitpix))
    if not 0 <= naxis <= 999:
        raise errors.BadNaxis(str(naxis))
    axes = [header.integer(f"NAXIS{i}") for i in range(1, naxis + 1)]
    if any(n < 0 for n in axes):
        raise errors.BadNaxis(str(axes))
    kinds = {"IMAGE": "image", "IUEIMAGE": "image", "TABLE": "ascii_table", "BINTABLE": "binary_table", "A3DTABLE": "binary_table"}
    kind = "primary" if number_ == 1 else kinds.get(header.text("XTENSION") or "", "other")
    if number_ == 1 and naxis > 0 and axes[0] == 0 and header.value("GROUPS") is True:
        kind = "random_groups"
    hdu = Hdu(number_, header, at, data_at, kind, bitpix, axes, header.integer("PCOUNT", 0), header.integer("GCOUNT", 1))
    if hdu.pcount < 0 or hdu.gcount < 0:
        raise errors.BadDimensions("PCOUNT or GCOUNT")
    _ = hdu.data_bytes
    return hdu


def scan(f, size: int, upto: int | None = None):
    """The HDUs of a file, one after the other.

    What follows the last one and has no header is left alone; a header with other errors is an error.
    """
    at, n = 0, 0
    while at < size and (upto is None or n < upto):
        n += 1
        if n > LIMITS["hdus"]:
            raise errors.LimitExceeded("HDUs")
        try:
            header, data_at = Header.read(f, at)
        except (errors.HeaderError, errors.ValueFormatError):
            if n == 1:
                raise
            return
        try:
            hdu = make_hdu(n, header, at, data_at)
        except (errors.MissingRequiredKeyword, errors.BadExtension):
            if n == 1:
                raise
            return
        yield hdu
        at = hdu.end
    if n == 0:
        raise errors.MissingRequiredKeyword("SIMPLE")
