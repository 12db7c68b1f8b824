"""Macro expansion, case by case."""

import random
import time

import pytest

from quirelab.sources import papers
from quirelab.sources.tex_macros import expanded


@pytest.mark.parametrize(
    "source, wanted",
    [
        (r"\newcommand{\us}{our method}We show \us.", "We show our method."),
        (r"\newcommand\pair[2]{<#1|#2>}\pair{a}{b} \pair cd \pair{\pair{1}{2}}3", "<a|b> <c|d> <<1|2>|3>"),
        (r"\newcommand{\opt}[2][left]{#2 is #1}\opt{x}, \opt[right]{y}, \opt[{[}]{z}, \opt [far] {w}", "x is left, y is right, z is {[}, w is far"),
        (r"\newcommand{\a}{A}\newcommand{\b}{\a\a}\renewcommand{\a}{Z}\b", "ZZ"),
        (r"\providecommand{\a}{1}\providecommand{\a}{2}\a", "1"),
        (r"\def\until#1;{(#1)}\until x y; \until {a;b};.", "(x y) (a;b)."),
        (r"\def\swap#1/#2.{#2/#1}\swap left/right.!", "right/left!"),
        (r"\def\two#1#2{#2#1}\two xy\two{1}{2}", "yx21"),
        (r"\def\at(#1){[#1]}\at(3) \at 3", r"[3] \at 3"),
        (r"\let\old=\emph\let\new\old\new{x}", r"\emph{x}"),
        (r"\DeclareMathOperator*{\argmax}{arg\,max}\argmax_x", r"\operatorname{arg\,max}_x"),
        (r"\newcommand{\x}{1}{\renewcommand{\x}{2}\x}\x", "{2}1"),
        (r"{\gdef\g{G}}\g", "{}G"),
        (r"\newcommand{\mk}[1]{\def\made##1{#1##1}}\mk{p}\made{q}", "pq"),
        (r"\newcommand{\z}{\alpha}\z x", r"\alpha x"),
        (r"\newcommand{\z}{\alpha}a\z{}x\zz", r"a\alpha{}x\zz"),
        (r"\begin{verbatim}\us{\end{verbatim}\newcommand{\us}{U}\us", r"\begin{verbatim}\us{\end{verbatim}U"),
        (r"\newcommand{\f}[1]{<#1>}\f", r"\f"),
        (r"\newcommand{\f}[2]{<#1>}\f{a", r"\f{a"),
        (r"\newcommand{\f}", r"\newcommand{\f}"),
        (r"a } b { c \\ \% \#", r"a } b { c \\ \% \#"),
        ("", ""),
    ],
)
def test_expansion(source, wanted):
    assert expanded(source) == wanted


def test_recursion_ends_with_the_budget():
    began = time.time()
    assert "\\r" in expanded(r"\newcommand{\r}{x\r}\r", expansions=100)
    doubling = expanded(r"\newcommand{\d}{\d\d}\d end", expansions=200)
    assert doubling.endswith("end") and doubling.count("\\d") <= 201
    bomb = r"\def\a{xxxxxxxxxx}" + "".join(rf"\def\{chr(98 + k)}{{\{chr(97 + k)}\{chr(97 + k)}\{chr(97 + k)}\{chr(97 + k)}}}" for k in range(20)) + r"\u"
    assert len(expanded(bomb)) < 9_000_000 and time.time() - began < 20


def test_texts_without_macros_stay_as_they_are():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["\\", "{", "}", "[", "]", "#", "#1", " ", "\n", "a", "bc", "\\x", "é", "%", "\\begin{x}"]) for _ in range(rng.randint(0, 40)))
        again = expanded(text)
        assert again.replace(" ", "") == text.replace(" ", ""), text


def test_papers_with_macros_of_arguments():
    tex = r"\newcommand{\term}[2][set]{#2 of the #1}\def\see#1;{as in #1}\begin{document}\section{The \term{size}}It is \term[list]{sum}, \see one;.\end{document}"
    assert [(k, t) for _, _, k, t in papers.latex_body(tex)] == [("heading", "The size of the set"), ("paragraph", "It is sum of the list, as in one.")]


def test_words_between_marks_are_one_token():
    from quirelab.sources.tex_macros import Expander

    text = "some words\n of text " * 1000 + "\\newcommand{\\us}[1]{our #1 method}\\us ab and \\newcommand{word}{two words} more word here \\us{word}"
    assert len(Expander(text).todo) < 30
    assert Expander(text).run() == "some words\n of text " * 1000 + "our a methodb and  more two words here our two words method"


def test_a_long_text_does_not_spend_the_budget():
    assert expanded(r"\newcommand{\us}{our}" + "word " * 100 + r"\us", length=50) == "word " * 100 + "our"
    endless = expanded(r"\newcommand{\r}{xxxxxxxxxx\r}" + "word " * 100 + r"\r", length=50)
    assert "\\r" in endless and len(endless) < 700
