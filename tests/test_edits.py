"""Edit trees back to markup."""

import random

from quirespark.functions import markup as mk

TAGS = {1: ("em", "<em>", False), 2: ("a:b", '<a href="x">', False), 7: ("br", "<br/>", True), 9: ("img", "<img/>", True), 12: ("span", '<span class="smallcaps">', False)}


def by_recursion(tree, tags):
    """The plain definition."""
    added, numbers = {}, iter(range(max(tags, default=0) + 1, 10**6))

    def walk(nodes, depth):
        if depth > mk.EDIT_DEPTH:
            return ""
        out = ""
        for n in nodes:
            inner = lambda n=n: walk(n.get("c") or [], depth + 1)
            if isinstance(n.get("x"), str):
                out += n["x"].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            elif n.get("br"):
                k = next(numbers)
                added[k] = ("br", "<br/>", True)
                out += f"<br_{k}/>"
            elif isinstance(n.get("k"), int):
                tag = tags.get(n["k"])
                name = f"{mk.safe_name(tag[0])}_{n['k']}" if tag else ""
                out += inner() if tag is None else f"<{name}/>" if tag[2] else f"<{name}>{i}</{name}>" if (i := inner()) else ""
            elif n.get("f") in ("em", "strong"):
                i = inner()
                if i:
                    k = next(numbers)
                    added[k] = (n["f"], f"<{n['f']}>", False)
                    out += f"<{n['f']}_{k}>{i}</{n['f']}_{k}>"
            else:
                out += inner()
        return out

    return " ".join(walk(tree, 0).split()), added


def grown(rng, depth=0):
    kind = rng.choice(["x", "x", "br", "k", "f", "other", "unknown"])
    node = {"x": {"x": rng.choice(["a", " ", "", "b <c> & d", "\n é"])}, "br": {"br": True}, "k": {"k": rng.choice(list(TAGS))}, "f": {"f": rng.choice(["em", "strong", "u"])}, "other": {}, "unknown": {"k": 99}}[kind]
    if kind not in ("x", "br") and depth < 26:
        node["c"] = [grown(rng, depth + 1) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    return node


def test_edits_equal_the_recursion():
    rng = random.Random(1)
    for _ in range(400):
        tree = [grown(rng) for _ in range(rng.randrange(4))]
        assert mk.from_edit(tree, TAGS) == by_recursion(tree, TAGS)


def test_depth_is_cut():
    def nested(n):
        return [{"x": "deep"}] if n == 0 else [{"k": 1, "c": nested(n - 1)}]

    assert "deep" in mk.from_edit(nested(20), TAGS)[0]
    assert mk.from_edit(nested(21), TAGS) == ("", {})
    assert mk.from_edit([{"k": 12, "c": [{"c": nested(5000 // 10)}]}], TAGS) == ("", {})


def test_unedited_markup_comes_back():
    for text in ["a <em_1>b <a-b_2>c</a-b_2></em_1><br_7/>d<img_9/> <span_12>e</span_12>", "x &amp; y &lt; z", "", "<em_1>è</em_1>"]:
        tree = mk.edit_tree(mk.safe_html(text, TAGS))
        assert mk.from_edit(tree, TAGS) == (text, {})


def test_what_the_reader_adds():
    assert mk.from_edit(mk.edit_tree('<p>a <i>b</i></p><b>c<br></b><x data-k="99">d</x></nothing><em>'), TAGS) == ("a <em_13>b</em_13><strong_15>c<br_14/></strong_15>d", {13: ("em", "<em>", False), 14: ("br", "<br/>", True), 15: ("strong", "<strong>", False)})
    assert mk.look_of('<span class="sc">') == "sc" and mk.look_of('<span class="descr">') is None and mk.look_of('<span style="font-style:italic">') == "it" and mk.look_of('<span class="Bold em">') == "it"
