"""Size, turn and kind of image files from their headers, as SQL expressions over a BINARY column.

Nothing is decoded: marker segments, chunks and tag directories are walked by their lengths inside the JVM. A walk
follows at most ``STEPS`` segments before the picture data; a file with more is not readable here.
"""
from __future__ import annotations

STEPS = 1024


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _big(b: str, at: str, n: int) -> str:
    """Unsigned integer of ``n`` bytes at the one-based place ``at``, null beyond the end."""
    return f"CASE WHEN length({b}) >= {at} + {n - 1} THEN CAST(conv(hex(substring({b}, {at}, {n})), 16, 10) AS BIGINT) END"


def _little(b: str, at: str, n: int) -> str:
    return "(" + " + ".join(f"{256 ** i}L * {_byte(b, f'{at} + {i}')}" for i in range(n)) + ")"


def _byte(b: str, at: str) -> str:
    return f"({_big(b, at, 1)})"


def _is(b: str, at: str, text: str) -> str:
    return f"(hex(substring({b}, {at}, {len(text) // 2})) = '{text}')"


def _place(value: str) -> str:
    """A place of a file that is read whole, or null."""
    return f"try_cast({value} AS INT)"


# ---- tag directories (TIFF, and the EXIF block of other files) --------------------------------

def _tags(b: str, base: str) -> str:
    """Struct of the first directory at ``base``: width, height, turn, bits and whether another directory follows."""
    def number(at, n):
        return f"(CASE WHEN d.le THEN {_little(b, at, n)} ELSE {_big(b, at, n)} END)"

    def tag(code):
        value = f"CASE {number('e + 2', 2)} WHEN 3 THEN {number('e + 8', 2)} WHEN 4 THEN {number('e + 8', 4)} END"
        return f"get(transform(filter(d.entries, e -> {number('e', 2)} = {code}), e -> {value}), 0)"

    # Bits of several samples lie elsewhere: the entry holds their place.
    held = _place("d.base + " + number("e + 8", 4))
    many = f"get(transform(filter(d.entries, e -> {number('e', 2)} = 258 AND {number('e + 4', 4)} > 2), e -> {held}), 0)"
    bits = f"coalesce({_let(many, 'm', number('m', 2))}, {tag(258)})"
    whole = (f"named_struct('width', {tag(256)}, 'height', {tag(257)}, 'turn', {tag(274)}, 'bits', {bits}, "
             f"'more', coalesce({number('d.first + 2 + 12 * d.n', 4)} > 0, false))")
    first = _place(f"d.base + {number('d.base + 4', 4)}")
    steps = [
        ("d", f"named_struct('base', {base}, 'le', {_is(b, base, '49492A00')})"),
        ("d", f"named_struct('base', d.base, 'le', d.le, 'first', {first})"),
        ("d", f"named_struct('base', d.base, 'le', d.le, 'first', d.first, 'n', CAST({number('d.first', 2)} AS INT))"),
        ("d", "named_struct('base', d.base, 'le', d.le, 'first', d.first, 'n', d.n, 'entries', "
              "CASE WHEN d.n > 0 THEN transform(sequence(0, d.n - 1), i -> d.first + 2 + 12 * i) ELSE CAST(array() AS ARRAY<INT>) END)"),
    ]
    for name, value in reversed(steps):
        whole = _let(value, name, whole)
    return f"CASE WHEN {_is(b, base, '49492A00')} OR {_is(b, base, '4D4D002A')} THEN {whole} END"


def _turn(b: str, base: str) -> str:
    return f"CASE WHEN {base} IS NOT NULL THEN {_let(_tags(b, base), 't', 't.turn')} END"


# ---- walks ------------------------------------------------------------------------------------

def _chunk(b: str, start: int, step: str, wanted: str, last: str) -> str:
    """Place of the first chunk for which ``wanted`` holds, before one for which ``last`` holds; ``step`` leads to the next."""
    return (f"aggregate(sequence(1, {STEPS}), named_struct('at', {start}, 'hit', CAST(NULL AS INT), 'over', false), (s, i) -> CASE WHEN s.over THEN s "
            f"WHEN s.at IS NULL OR s.at + 8 > length({b}) OR {last} THEN named_struct('at', s.at, 'hit', s.hit, 'over', true) "
            f"WHEN {wanted} THEN named_struct('at', s.at, 'hit', s.at, 'over', true) "
            f"ELSE named_struct('at', {_place(step)}, 'hit', s.hit, 'over', false) END).hit")


def _jpeg(b: str) -> str:
    """Walks marker segments to the frame header and remembers the first EXIF block."""
    marker = f"hex(substring({b}, s.at + 1, 1))"
    state = "named_struct('at', {at}, 'exif', {exif}, 'frame', {frame}, 'over', {over})".format
    rest = _place(f"s.at + 2 + {_big(b, 's.at + 2', 2)}")
    walk = (f"aggregate(sequence(1, {STEPS}), {state(at='3', exif='CAST(NULL AS INT)', frame='CAST(NULL AS INT)', over='false')}, (s, i) -> CASE WHEN s.over THEN s "
            f"WHEN s.at IS NULL OR NOT {_is(b, 's.at', 'FF')} OR {marker} IN ('', 'D9', 'DA') THEN {state(at='s.at', exif='s.exif', frame='s.frame', over='true')} "
            f"WHEN {marker} = 'FF' THEN {state(at='s.at + 1', exif='s.exif', frame='s.frame', over='false')} "
            f"WHEN {marker} = '01' OR {marker} RLIKE '^D[0-7]$' THEN {state(at='s.at + 2', exif='s.exif', frame='s.frame', over='false')} "
            f"WHEN {marker} RLIKE '^C[0-35-79ABD-F]$' THEN {state(at='s.at', exif='s.exif', frame='s.at', over='true')} "
            f"WHEN {marker} = 'E1' AND s.exif IS NULL AND {_is(b, 's.at + 4', '457869660000')} THEN {state(at=rest, exif='s.at + 10', frame='s.frame', over='false')} "
            f"ELSE {state(at=rest, exif='s.exif', frame='s.frame', over='false')} END)")
    found = (f"named_struct('format', 'JPEG', 'width', {_big(b, 'w.frame + 7', 2)}, 'height', {_big(b, 'w.frame + 5', 2)}, 'turn', {_turn(b, 'w.exif')}, "
             f"'bits', {_byte(b, 'w.frame + 4')}, 'frames', false, 'whole', contains(substring({b}, w.frame), X'FFD9'))")
    return _let(walk, "w", found)


def _png(b: str) -> str:
    step = f"s.at + 12L + {_big(b, 's.at', 4)}"
    kind = lambda text: _is(b, "s.at + 4", text)
    data = kind("49444154")
    return (f"named_struct('format', 'PNG', 'width', {_big(b, '17', 4)}, 'height', {_big(b, '21', 4)}, "
            f"'turn', {_let(_chunk(b, 9, step, kind('65584966'), data), 'c', _turn(b, 'c + 8'))}, 'bits', {_byte(b, '25')}, "
            f"'frames', {_chunk(b, 9, step, kind('6163544C'), data)} IS NOT NULL, 'whole', contains({b}, X'49454E44AE426082'))")


def _bmp(b: str) -> str:
    old = f"{_little(b, '15', 4)} = 12"
    # Rows from top to bottom are marked by a negative height.
    height = _let(_little(b, "23", 4), "h", "CASE WHEN h >= 2147483648L THEN 4294967296L - h ELSE h END")
    return (f"named_struct('format', 'BMP', 'width', CASE WHEN {old} THEN {_little(b, '19', 2)} ELSE {_little(b, '19', 4)} END, "
            f"'height', CASE WHEN {old} THEN {_little(b, '21', 2)} ELSE {height} END, 'turn', CAST(NULL AS BIGINT), 'bits', 8L, 'frames', false, "
            f"'whole', length({b}) > {_little(b, '11', 4)})")


def _webp(b: str) -> str:
    size = _little(b, "s.at + 4", 4)
    step = f"s.at + 8L + {size} + {size} % 2"
    bits = _little(b, "22", 4)
    width = (f"CASE hex(substring({b}, 13, 4)) WHEN '56503820' THEN {_little(b, '27', 2)} & 16383L WHEN '5650384C' THEN ({bits} & 16383L) + 1 "
             f"WHEN '56503858' THEN {_little(b, '25', 3)} + 1 END")
    height = (f"CASE hex(substring({b}, 13, 4)) WHEN '56503820' THEN {_little(b, '29', 2)} & 16383L WHEN '5650384C' THEN (shiftright({bits}, 14) & 16383L) + 1 "
              f"WHEN '56503858' THEN {_little(b, '28', 3)} + 1 END")
    exif = _let(_chunk(b, 13, step, _is(b, "s.at", "45584946"), "false"), "c",
                _turn(b, f"CASE WHEN {_is(b, 'c + 8', '457869660000')} THEN c + 14 ELSE c + 8 END"))
    return (f"named_struct('format', 'WEBP', 'width', {width}, 'height', {height}, 'turn', CASE WHEN {_is(b, '13', '56503858')} THEN {exif} END, 'bits', 8L, "
            f"'frames', {_is(b, '13', '56503858')} AND ({_byte(b, '21')} & 2) = 2, 'whole', length({b}) >= {_little(b, '5', 4)} + 8)")


def _tiff(b: str) -> str:
    return _let(_tags(b, "1"), "t", "named_struct('format', 'TIFF', 'width', t.width, 'height', t.height, 'turn', t.turn, 'bits', coalesce(t.bits, 1L), 'frames', t.more, 'whole', true)")


def image_header(b: str) -> str:
    """STRUCT<format, width, height, turn, bits, frames, whole>, or null where no known signature begins the bytes.

    Sizes are those stored; ``turn`` is the EXIF orientation. ``frames``: several pictures, ``whole``: the end is there.
    """
    return (f"CASE WHEN {_is(b, '1', 'FFD8FF')} THEN {_jpeg(b)} WHEN {_is(b, '1', '89504E470D0A1A0A')} THEN {_png(b)} "
            f"WHEN {_is(b, '1', '424D')} THEN {_bmp(b)} WHEN {_is(b, '1', '52494646')} AND {_is(b, '9', '57454250')} THEN {_webp(b)} "
            f"WHEN {_is(b, '1', '49492A00')} OR {_is(b, '1', '4D4D002A')} THEN {_tiff(b)} END")
