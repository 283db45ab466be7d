"""Text functions against Python's own regex engine and hand-written cases."""

from __future__ import annotations

import json
import random
import re
from functools import reduce

import pytest

from checks.oracles import ERROR_STEMS, STOP_WORDS
from lumberline.functions import answers, names, text

# Character classes that tell regex engines apart: combining marks, superscripts, odd blanks, other scripts.
ALPHABET = list("abcdefxyzADFXZ0123456789 =:-._/()[]#\t") + list("éßſıİœ²½١३一́ͅ 　 \x85\x1c\x0b€–😀")
SNIPPETS = ["0x1f", "=0xAB", "=enable", "dead", "face", "01-02 03:04:05.678  10  11 E ", "the", "Not", "http://", "ſ"]


@pytest.fixture(scope="module")
def wild():
    rng = random.Random(7)
    lines = ["", " ", "a", "=", "0x", "_dead_", "édead", "dead²", "10 1.5 3 4 E", "10 1.5　3 4 ß\x85x"]
    for _ in range(3000):
        pool = rng.choice([ALPHABET, ALPHABET[:38], ALPHABET + SNIPPETS * 4])
        lines.append("".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))))
    return lines


def expected_key(line: str) -> str:
    # The four steps of the key.
    steps = [
        (r"[0-9-]+\s+[0-9:.]+\s+[0-9]+\s+[0-9]+\s+\w\s", ""),
        (r"=0x[a-fA-F0-9]+|0x[a-fA-F0-9]+|=[a-fA-F0-9]+|\b[a-fA-F0-9]+\b", ""),
        (r"[^a-zA-Z]", " "),
        (r"\b[a-zA-Z]\b", " "),
    ]
    left = reduce(lambda value, step: re.sub(step[0], step[1], value), steps, line + "\n")
    return " ".join(word for word in left.split() if word.lower() not in STOP_WORDS)


def test_word_lists_of_code_and_checks_agree():
    assert {*text.STOP_WORDS, *text.STOP_LETTERS} == set(STOP_WORDS)
    assert text.ERROR_STEMS == ERROR_STEMS.split("|")


def test_cleaned_key_is_what_python_gives(apply, wild):
    assert apply(wild, text.cleaned_key) == [expected_key(line) for line in wild]


def test_cleaned_key_cases(apply):
    cases = {
        "01-02 03:04:05.678  10  11 E Tag: the Value=0x1f at 12": "Tag Value",
        "dead face add": "",
        "=enable x": "nable",
        "": "",
        "12 34": "",
        "Don't stop NOT now": "stop",
        "abc0x1fghi": "abcghi",
    }
    assert apply(cases, text.cleaned_key) == list(cases.values())


def test_long_digit_runs_stay_linear(apply):
    assert apply(["1" * 300_000 + " " + "a" * 300_000], lambda c: text.cleaned_key(c)) == [""]


def test_normalized_line_is_what_python_gives(apply, wild):
    def expected(line):
        left = re.sub(r"\b\d+\b", "", re.sub("0x[0-9a-fA-F]+", "", line))
        return " ".join(re.sub(r"[^a-zA-Z\s]", "", left).split())

    assert apply(wild, text.normalized_line) == [expected(line) for line in wild]


def test_strip_blanks_is_python_strip(apply, wild):
    assert apply(wild, text.strip_blanks) == [line.strip() for line in wild]


def test_stop_words_leave_texts(apply, wild):
    def expected(line):
        stop = {*text.STOP_WORDS, *text.STOP_LETTERS}
        return " ".join(w for w in re.findall(r"\w+", line) if w.lower() not in stop)

    probes = wild + ["I can't do THIS 12 times", "naïve_word s x"]
    assert apply(probes, text.without_stop_words) == [expected(line) for line in probes]


def test_error_stems_match_in_any_case(apply, wild):
    stems = re.compile("|".join(text.ERROR_STEMS), re.IGNORECASE)
    probes = wild + ["NOTIFY", "nothing", "TimeOut", "craſh", "fine"]
    assert apply(probes, text.has_error_stem) == [bool(stems.search(line)) for line in probes]


def test_url_lines_are_case_sensitive(apply):
    probes = ["a http://x", "https://", "rtsp://v", "HTTP://x", "ftp://x", "http:/x"]
    assert apply(probes, text.has_url) == [True, True, True, False, False, False]


def test_rendered_lines_parse_back(apply):
    probes = ["Line 12: a: b", "7:Line 3:  x", "  8:  Line 4 : y", "8: plain", "none", "Line 99999999999999999999: z"]
    parsed = [(row["line_no"], row["log"]) for row in apply(probes, text.parse_rendered)]
    assert parsed == [(12, "a: b"), (3, "x"), (4, "y"), (None, "plain"), (None, "none"), (None, "z")]
    assert apply(["Line 1:  a:b  ", "no colon "], text.rendered_tail) == ["a:b", "no colon"]


def test_truncation(apply):
    values = ["ab\ncd\nef", "abcdefgh\nx", "", None, "ab\r\ncd\rx", "abc\n"]
    assert apply(values, lambda c: text.truncate_whole_lines(c, 5)) == ["ab\n", "abcde", "", "", "ab\n", "abc\n"]
    assert apply(values, lambda c: text.truncate_whole_lines(c, 6)) == ["ab\ncd\n", "abcdef", "", "", "ab\ncd\n", "abc\n"]
    assert apply(values, lambda c: text.truncate_whole_lines(c, 0)) == [""] * 6
    assert apply(["abc", "", None], lambda c: text.truncate_chars(c, 2)) == ["ab", "", ""]
    assert apply(["a\nb😀\n"], text.char_length) == [3]


def test_fences_and_think_tags(apply):
    fenced = ["```markdown\n# A\n```", " \n```markdown x\nbody\n\n``` ", "```markdown\nopen", " plain ", None, "```markdown\n\n```"]
    assert apply(fenced, answers.unfence_markdown) == ["# A", "body", "```markdown\nopen", "plain", "", ""]
    thought = ["a<think> x </think>b", "<think>open", "none", "</think><think>y</think>c</think>"]
    assert apply(thought, answers.think_content) == ["x", None, None, "y"]
    assert apply(thought, answers.without_think) == ["b", "<think>open", "none", "c</think>"]


def test_fenced_json_is_lenient(apply):
    probes = [
        'x ```json\n{"a": 1}\n``` y',
        "```json {'a': 1}```",
        "```json {a: 1 /* c */}```",
        '```json {"a": 1,}```',
        "```json {a: 1, // it's last, }\n }```",
        "```json {a```",
        "no fence",
    ]
    read = apply(probes, lambda c: answers.fenced_json(c).cast("string"))
    assert read == ['{"a":1}'] * 5 + [None] * 2
    kept = ['```json {"a": ",}", \'b\': [1, 2, ], "c": "it\\\'s \\d"}```', "```json [',]', \"/* , } */\",]```"]
    assert apply(kept, lambda c: answers.fenced_json(c).cast("string")) == ['{"a":",}","b":[1,2],"c":"it\'s d"}', '[",]","/* , } */"]']


def test_json_takes_numbers_in_any_form(apply):
    probes = {
        "[.5, +1, 5., 0x1F, -0X1f, -.5, +.25, -7., 1.e2, +0xA]": "[0.5,1,5.0,31,-31,-0.5,0.25,-7.0,100.0,10]",
        '{a:+1,"b+.5":".5 0x1F +1",c:[5.],\'d\':\'+1 5.\'}': '{"a":1,"b+.5":".5 0x1F +1","c":[5.0],"d":"+1 5."}',
        "[1, -2, 3.5, 1e5, -1.5E-3]": "[1,-2,3.5,100000.0,-0.0015]",
        "[5. /* .5 +1 */, // 0x1F\n .5]": "[5.0,0.5]",
        "{x0x1F: 0xff, $a: 1.5}": '{"$a":1.5,"x0x1F":255}',
        "[0xFFFFFFFFFFFFFFFF, 1.2.3]": None,
        "[.]": None,
        "[+]": None,
    }
    read = apply([f"```json {p}```" for p in probes], lambda c: answers.fenced_json(c).cast("string"))
    plain = lambda t: t and json.loads(t)
    assert list(map(plain, read)) == list(map(plain, probes.values()))


def test_module_names(apply):
    assert apply(["Audio-Hal", " audio_hal.", "ÄU 1", "", None], names.module_key) == ["audiohal", "audiohal", "äu1", "", ""]
    assert apply(["Audio-Hal, amp,,amp", " , ", ""], names.requested_modules) == [["Audio-Hal", "amp"], [], []]
    links = {"class_3": "https://docs.example.com/3"}
    assert apply(["class_3", "x", None], lambda c: names.class_link(c, links)) == [links["class_3"], "", ""]
