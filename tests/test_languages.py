import pytest

from phrasegrid.lang.command import Command, CommandError, parse_command, parse_script
from phrasegrid.lang.filter import Filter, FilterError, contents, parse_filter, same_filter
from phrasegrid.lang.sort import SortBy, SortError, parse_sort, parse_sorts
from phrasegrid.params import Params


def test_filter_precedence():
    f = parse_filter("ext:MD or not ext:txt AND path-date:<=2024-01-31")
    assert f.op == "or" and f.parts[0] == Filter("ext", value=".md")
    assert f.parts[1].op == "and" and f.parts[1].parts[0].op == "not"
    assert f.parts[1].parts[1] == Filter("path-date", value="2024-01-31", compare="<=")


def test_filter_values():
    assert parse_filter("") == Filter("all")
    assert parse_filter("\"a \\\" b\"") == Filter("content", value='a " b')
    assert parse_filter("path-glob:'x y/*.md'").value == "x y/*.md"
    assert contents(parse_filter("content:a or (\"b\" and not 'c')")) == ["a", "b", "c"]
    assert same_filter(parse_filter("ext:a"), parse_filter("ext:a")) and not same_filter(parse_filter("mod-date:>2024-01-01"), parse_filter("mod-date:>2024-01-01"))


@pytest.mark.parametrize("text", ["(ext:a", "ext:", "nope:a", "path-date:2024-01-01", "path-date:>2024-13-01", "content:(", "ext:a ext:b"])
def test_filter_errors(text):
    with pytest.raises(FilterError):
        parse_filter(text)


@pytest.mark.parametrize(
    "text",
    [
        "search: a b", "clear search", "filter: ext:md", "clear filter", "narrow level: 3", "mark: /a b", "mark listed", "unmark: /a", "unmark listed", "unmark all", "drop: /a",
        "drop all except: /a", "drop marked", "drop unmarked", "drop listed", "drop unlisted", "sort by: score,desc; path,asc", "path fuzzy rank: a", "focus: /a", "split screen: even",
        "hide-pane: key-binding-info", "show-pane: key-binding-info", "# note",
    ],
)
def test_commands_round_trip(text):
    assert str(parse_command(text)) == text


def test_scripts():
    assert parse_script("\n; skipped\nsearch: a\n") == [Command("search", "a")]
    with pytest.raises(CommandError, match="line 2"):
        parse_script("mark listed\nnonsense")
    with pytest.raises(CommandError):
        parse_command("narrow level: 10")


def test_sorts():
    assert parse_sorts("score,desc; path-date,asc") == (SortBy("score", True), SortBy("path-date"))
    for bad in ("score", "size,asc", "path,up"):
        with pytest.raises(SortError):
            parse_sort(bad)
    with pytest.raises(SortError):
        parse_sorts("path,asc; score,desc")


def test_params():
    with pytest.raises(ValueError):
        Params(max_token_search_dist=0)
    with pytest.raises(ValueError):
        Params(max_fuzzy_edit_dist=-1)
