"""Inspected examples of prose, lists, tables and junk, written after reading documents of each kind.

They name the components of a mixture; nothing is fitted to their kinds. Longer ones are put together from a few parts.
"""

from __future__ import annotations

import hashlib

#: Names, regions and pieces that the examples speak of.
CELLS = ["vTalmon3", "dSurpek12a", "lVasnor4a", "pBolgir7", "mKirdan2", "aFelso15b", "dOrbik9", "vPelmar21c", "lTuskon1", "mGerrid18", "aSolvek6b", "pHuntar10"]
PLACES = ["TUR(L)", "LOB", "KEM(R)", "TUR(R)", "VAL"]
PIECES = ["the axon, dense", "a thin branch, badly stained", "the cell body, faint"]
DONE = ["checked", "merged", "followed"]
#: Sentences of the four languages and of short notes.
ENGLISH = [
    "The second reader followed the axon of lVasnor4a again, because the stain was poor there.",
    "It ends close to the border of TUR(L), as far as the picture shows, and we would keep the old name for now.",
    "Most of what we know about dSurpek12a comes from last year, when the whole block was read by the night shift.",
    "A few points near LOB are enough to move the mean, so the region should be looked at with care.",
    "There is no sign that both are the same cell, even if the count for vTalmon3 is right.",
    "At first the number of partners fell from 412 to 55, and this is not clear to us.",
    "All that is left to do is to have the main branch checked by someone who knows the left side.",
]
GERMAN = ["Etwa die Hälfte der Eingänge von lVasnor4a kommt aus TUR(L), und das ist für die Zählung nicht wichtig.", "Am Ende wurde der Name nicht geändert, weil die Zahl klein war.", "Wenn die Probe so dicht ist, muss sie in den meisten Fällen von Hand geprüft werden.", "Nach 12 Tagen war auch der Rest von vTalmon3 verbunden."]
FRENCH = ["Nous avons vérifié le lien entre lVasnor4a et vTalmon3, mais on voit encore que la branche se termine près du bord.", "Pour cette raison, le nom de dSurpek12a reste le même.", "Environ 40 des entrées viennent de TUR(R), et il faut que tout soit mesuré encore une fois."]
SPANISH = ["En esta región la señal es buena, pero todavía se ve que el axón termina cerca de LOB.", "Por eso el nombre de la célula no cambia, ya que el lado izquierdo era igual.", "Unas 30 de las entradas de vTalmon3 vienen de dSurpek12a y no de TUR(L)."]
NOTES = ["Traced lVasnor4a through TUR(R), membrane torn, signal weak near LOB.", "Asked the other tracer, answer pending.", "Nothing new around TUR(L), keep separate.", "Count low, a thin twig checked by hand.", "vTalmon3 done, lVasnor5 next."]


def _varied(sentences: list[str], n: int) -> list[str]:
    """``n`` sentences: those given, again and again with other names and numbers and in another order."""
    out = []
    for i in range(n):
        text = sentences[(i * 3 + i // len(sentences)) % len(sentences)]
        for old, step in (("vTalmon3", 1), ("lVasnor4a", 5), ("dSurpek12a", 7)):
            text = text.replace(old, CELLS[(i * step + step) % len(CELLS)])
        for old, step in (("TUR(L)", 1), ("LOB", 2), ("TUR(R)", 3)):
            text = text.replace(old, PLACES[(i + step) % len(PLACES)])
        out.append(text.replace("12 ", f"{(i * 17) % 90 + 3} ").replace("40", str((i * 29) % 90 + 5)).replace("55", str((i * 31) % 80 + 7)))
    return out


def _text(sentences: list[str], times: int, join: str = " ") -> str:
    return join.join(_varied(sentences, max(2, 3 * times)))


def _wrapped(text: str, width: int) -> str:
    lines, line = [], ""
    for word in text.split(" "):
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return "\n".join([*lines, line])


def _items(n: int, end: str = "") -> list[str]:
    """Entries of a list: a cell, a cell with a place or a remark, or a piece."""
    out = []
    for i in range(n):
        cell = CELLS[i * 5 % len(CELLS)]
        out.append([cell, f"{cell} {PLACES[i % len(PLACES)]}", f"{cell}: {DONE[i % 3]}", PIECES[i % 3]][i * 3 % 4] + end)
    return out


def _rows(n: int, width: int, remark: bool = False, numbers_only: bool = False) -> list[list[str]]:
    """A header and rows of a table."""
    value = lambda i, j: ["0.%03d" % ((i * 37 + j * 411) % 1000), str((i * 131 + j * 57) % 1999), "NA"][(i + j) % 7 % 3]
    heads = ["name", "post", "count", "ratio", "rank", "side", "weight", "hops"][:width]
    rows = [heads + (["remark"] if remark else [])]
    for i in range(n):
        cells = [value(i, j) for j in range(width)] if numbers_only else [CELLS[i % 12], CELLS[(i * 7 + 3) % 12], *[value(i, j) for j in range(width - 2)]]
        rows.append(cells + (["after the second reading of the block"] if remark else []))
    return rows


def _joined(rows: list[list[str]], sep: str, left: str = "", right: str = "") -> str:
    return "\n".join(left + sep.join(r) + right for r in rows)


def _spaced(rows: list[list[str]], width: int = 14) -> str:
    return "\n".join("".join(c.ljust(width) for c in r).rstrip() for r in rows)


def _framed(rows: list[list[str]]) -> str:
    bar = "+" + "+".join(["-" * 14] * len(rows[0])) + "+"
    return "\n".join([bar, *["|" + "|".join(c.center(14) for c in r) + "|" for r in rows], bar])


def _markdown(rows: list[list[str]]) -> str:
    return "\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *["| " + " | ".join(r) + " |" for r in rows[1:]]])


def _noise(alphabet: str, n: int, seed: str, spaces: int = 0) -> str:
    """``n`` characters of ``alphabet`` in no order that one can read, with a blank at one place in ``spaces``."""
    out, block = [], b""
    for i in range(n):
        if i % 32 == 0:
            block = hashlib.sha256(f"{seed}{i}".encode()).digest()
        out.append(" " if spaces and block[i % 32] % spaces == 0 else alphabet[block[i % 32] * 7 % len(alphabet)])
    return "".join(out)


def _scrambled(text: str, every: int) -> str:
    return "".join(c if c == " " or int(hashlib.md5(f"{i}".encode()).hexdigest(), 16) % every else "~^_*<>{}|!;:'`\\"[i * 11 % 15] for i, c in enumerate(text))


def _examples() -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    add = lambda kind, *texts: out.extend((kind, t) for t in texts)
    # prose: as running text, wrapped, a sentence a line, without case or marks, with headings, short, and as notes
    for times in (1, 2, 4):
        english = _text(ENGLISH, times)
        add("prose", english, _wrapped(english, 52), _text(ENGLISH, times, "\n"), _text(ENGLISH, times, "\n\n"), english.upper(), english.lower().replace(".", " ...").replace(",", " ,"), _text(ENGLISH, times, "\n").lower().replace(".", ""))
        add("prose", *[_text(s, times) for s in (GERMAN, FRENCH, SPANISH, NOTES)], *[_wrapped(_text(s, times), 46) for s in (GERMAN, FRENCH, SPANISH, NOTES)], _text(NOTES, times, "\n"), _text(NOTES, times).upper(), _text(GERMAN, times).upper(), _text(FRENCH, times, "\n").lower(), f"## Notes\n{english}")
    for sentences in (ENGLISH, GERMAN, FRENCH, SPANISH, NOTES):
        for n in (2, 3):
            short = " ".join(_varied(sentences, n))
            add("prose", short, *[_wrapped(short, w) for w in (44, 58, 72)], f"## Notes\n{short}", "\n".join(_varied(sentences, n)), "\n".join(_varied(sentences, n)).lower().replace(".", ""))
    add("prose", ENGLISH[0], FRENCH[1], "Before you rename vTalmon3, please look at the branch in TUR(R)!")
    # prose with a small piece of something else
    for long in (_text(ENGLISH, 3), _text(ENGLISH, 6, "\n"), _wrapped(_text(GERMAN, 5), 60), _text(NOTES, 6)):
        add("prose", long + "\n\n" + "\n".join(f"- {x}" for x in _items(6)), "\n".join(f"{i + 1}. {x}" for i, x in enumerate(_items(5))) + "\n\n" + long, long + "\n\n" + _joined(_rows(4, 4), "\t"), _markdown(_rows(3, 4)) + "\n\n" + long, long + "\n\n" + _joined(_rows(4, 4), ","), long + "\n" + "\n".join(_items(7)), long + "\n\n" + _framed(_rows(2, 4)), long + "\n\n" + _spaced(_rows(3, 4)))
    # lists: by marker, end of line and length, with blank lines, with a sentence before them
    for n in (7, 20, 50):
        marks = [lambda i: "- ", lambda i: "* ", lambda i: "• ", lambda i: f"{i + 1}. ", lambda i: f"{i + 1}) ", lambda i: "[x] " if i % 3 else "[ ] ", lambda i: ""]
        for mark in marks:
            for end in ("", ".", ";"):
                add("list", "\n".join(mark(i) + x for i, x in enumerate(_items(n, end))))
        add("list", "\n\n".join(f"- {x}" for x in _items(n)), "\n\n".join(_items(n, ".")), "\n".join(("  - " if i % 4 == 3 else "- ") + x for i, x in enumerate(_items(n))), "\n".join(f"{PLACES[i % 5]}{' =' if i % 2 else ':'} {x}" for i, x in enumerate(_items(n))))
        add("list", ENGLISH[0] + "\n\n" + "\n".join(f"- {x}" for x in _items(n)), GERMAN[0] + ":\n\n" + "\n".join(f"{i + 1}. {x}" for i, x in enumerate(_items(n))), SPANISH[0] + "\n\n" + "\n".join(_items(n)), "\n".join(f"- {x}" for x in _items(n)) + "\n\n" + ENGLISH[3])
        mixed = [x for pair in zip(_varied(ENGLISH, n), _items(n), strict=True) for x in (pair[0].rstrip("."), pair[1])]
        for end in ("", ".", ";"):
            add("list", *["\n".join(f"{mark or f'{i + 1}. '}{x}{end}" for i, x in enumerate(items[:n])) for mark in ("- ", "* ", "[x] ", "") for items in (mixed, [s.rstrip(".") for s in _varied(GERMAN, n)], [s.rstrip(".") for s in _varied(ENGLISH, n)])])
        add("list", "\n\n".join(f"{i + 1}) {x}" for i, x in enumerate(mixed[:n])), FRENCH[2] + "\n\n" + "\n".join(f"- {x}" for x in mixed[:n]))
    add("list", *["\n".join(mark + s.rstrip(".") for s in _varied(sentences, 5)) for mark in ("- ", "* ", "• ") for sentences in (ENGLISH, GERMAN, FRENCH)])
    # tables: by separator and width, with a remark column, with a sentence before or after them
    for n, width in ((6, 3), (12, 5), (30, 7)):
        for rows in (_rows(n, width), _rows(n, width, remark=True), _rows(n, width, numbers_only=True)):
            add("table", _joined(rows, "\t"), _joined(rows, ","), _joined(rows, ", "), _joined(rows, ";"), _joined(rows, " | "), _joined(rows, " & ", right=" \\\\"), _spaced(rows), _framed(rows), _markdown(rows))
        add("table", *[s + "\n\n" + _joined(_rows(n, width), sep) for s, sep in ((FRENCH[0], "\t"), (ENGLISH[2], ","), (SPANISH[1], ";"))], _markdown(_rows(n, width)) + "\n\n" + ENGLISH[1], *[s + "\n\n" + _markdown(_rows(n, w)) for s in (ENGLISH[0], GERMAN[0]) for w in (3, 4)], GERMAN[3] + "\n\n" + _framed(_rows(n, width)))
    # junk: the same over and over
    add("junk", *[w * n for w in ("loading ", "click here to load the scene ") for n in (15, 60)], *["\n".join([w] * n) for w in ("page not found", "go to the next page") for n in (8, 40)], *[" ".join([s] * n) for s in (ENGLISH[4], GERMAN[2], FRENCH[1]) for n in (5, 15)], "\n".join([ENGLISH[4]] * 8), "ha " * 100)
    # junk: machine output
    add("junk", *["\n".join(f"[{i * 7 % 24:02d}:{i * 13 % 60:02d}:{i * 29 % 60:02d}] {['INFO', 'WARN', 'DEBUG'][i % 3]} worker-{i % 9} rc={i % 3} mem={i * 137 % 4000}M chunk={_noise('0123456789abcdef', 10, str(i))}" for i in range(n)) for n in (4, 15)])
    add("junk", *["\n".join(f"[{i * 5 % 24:02d}:{i * 17 % 60:02d}:{i * 31 % 60:02d}] {['INFO', 'WARN'][i % 2]} job={i % 4} rc={i % 2} mem={i * 37 % 90}" for i in range(n)) for n in (3, 5, 12)])
    add("junk", *["\n".join(_noise("0123456789abcdef", 48, f"h{i}") for i in range(n)) for n in (3, 12)], *["".join(f'<td>&nbsp;</td><br/>{{"k{i * 37 % 99}":null}}' for i in range(n)) for n in (8, 30)], _noise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 400, "b"))
    # junk: noise of signs, letters or both, and a broken encoding
    for n in (150, 600, 1500):
        add("junk", _noise("-=.*#!?", n, "s"), "".join(["-----", "=====", "....", "****", "!!!!", "?!?!"][int(c)] for c in _noise("012345", n // 5, "r")), _noise("qwrtpasdfghjklzeiou", n, "l", 8), _noise("qwkkttaazzeegghh", n, "d", 6), _noise("abcdefghijklmnopqrstuvwxyz0123456789%&/<>*_+=\\#", n, "m", 22), _noise("ÂÃ¼¬§©°�“‚ŸstnaoeÅ", n, "e", 20), _scrambled(_text(ENGLISH, 1 + n // 400), 3), _scrambled(_text(ENGLISH, 1 + n // 400), 6), _scrambled(_text(GERMAN, 1 + n // 400), 4))
    # junk: loose words and names
    for n in (15, 45, 120):
        names = [(CELLS + PLACES)[i * 5 % 17] for i in range(n)]
        loose = [w.strip(".,") for w in " ".join(ENGLISH[::-1]).split() if len(w) > 4] + CELLS
        add("junk", *[sep.join(names) for sep in (", ", " | ", " · ", " ", "; ", " / ")], " ".join(loose[i * 11 % len(loose)] for i in range(n)), " ".join(loose[i * 13 % len(loose)].lower() for i in range(n)))
    return out


EXAMPLES = _examples()
