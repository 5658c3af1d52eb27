"""Pieces of SQL that several oracles share."""

#: Full-width forms and what NFKC makes of them.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
#: White space as Python's \\s has it, as a class for RE2.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace(replace({text}, chr(0), ' '), {quoted(SPACE)}, ' ', 'g'), ' ')"


def cleaned(text: str) -> str:
    """Cleaning of texts that hold no entity and no compatibility character but full-width forms, no-break blanks and ellipses."""
    return collapsed(f"replace(translate({text}, {quoted(WIDE)}, {quoted(PLAIN)}), '…', '...')")
