import json
import random

from weftline.llm import formatting


def nested(depth, swapped):
    text = '"x"'
    for k in range(depth):
        pairs = [f'"k": {text}', f'"n": {k}']
        text = "{" + ", ".join(pairs[::-1] if swapped else pairs) + "}"
    return text


def test_order_of_fields_is_ignored_at_any_depth():
    for depth in (3, 600, 5000, 40000):
        a, b = nested(depth, False), nested(depth, True)
        assert formatting.canonical(a) == formatting.canonical(b)
        assert formatting.canonical(a)[0] == "f"
        assert formatting.canonical(a) != formatting.canonical(a.replace('"x"', '"y"'))


def test_own_parser_equals_json():
    r = random.Random(5)

    def value(depth):
        k = r.randrange(8 if depth else 6)
        if k < 6:
            return [None, True, "é\n\"", -1.5e-7, 12, ""][k]
        return [value(depth - 1) for _ in range(r.randrange(4))] if k == 6 else {str(j): value(depth - 1) for j in range(r.randrange(4))}

    def outcome(load, text):
        try:
            return repr(load(text))
        except ValueError:
            return "error"

    for _ in range(2000):
        text = json.dumps(value(4), indent=r.choice([None, 1]))
        at = r.randrange(len(text) + 1)
        for t in (text, text[:at], text[:at] + r.choice(',]}":1 -NI') + text[at:]):
            assert outcome(formatting._deep, t) == outcome(formatting._load, t)
