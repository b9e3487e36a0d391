import pytest

from papyrine.errors import SearchError
from papyrine.functions.text import fold_query
from papyrine.plans.query import DAY, candidate_limit, check_limit, extract_search_text, parse_query


@pytest.mark.parametrize(
    ("query", "kind"),
    [
        ("", "search_query_empty"),
        ("  \t", "search_query_empty"),
        ("a\0b", "search_query_invalid"),
        ('"open', "search_query_invalid"),
        ('""', "search_query_invalid"),
        ('"a"b', "search_query_invalid"),
        ('"a""b', "search_query_invalid"),
        ("http://x", "search_filter_unsupported"),
        ("12:30", "search_filter_unsupported"),
        ("a=b", "search_filter_unsupported"),
        ("ext>=x", "search_query_invalid"),
        ("a<b", "search_query_invalid"),
        ("modified:>2024-01-01", "search_query_invalid"),
        ("one AND two", "search_query_invalid"),
        ("ext:", "search_filter_empty"),
        ("ext:md extension:txt", "search_filter_conflict"),
        ("modified:2024-01-01 date>=2024-01-02", "search_filter_conflict"),
        ("created>=2024-02-01 created<=2024-01-01", "search_filter_conflict"),
        ("modified:2023-02-29", "search_date_invalid"),
        ("modified:0000-01-01", "search_date_invalid"),
        ("modified:2024-1-1", "search_date_invalid"),
        ('ext:"a b"', "search_query_invalid"),
    ],
)
def test_refused_queries(query, kind):
    with pytest.raises(SearchError) as e:
        parse_query(query)
    assert e.value.kind == kind
    assert not query.strip() or query not in e.value.user_message


def test_accepted_queries():
    p = parse_query('red "and" "say ""hi""" FileName:"my file" ext:..MD modified:>=2024-02-29 date:<=2024-03-01')
    assert p.phrases == ["red", "and", 'say "hi"']
    assert p.values == {"filename": "my file", "extension": "MD"}
    low, high = p.ranges["modified_at"]
    assert high - low == 2 * DAY
    assert extract_search_text("ext:md") is None
    assert extract_search_text("a b") == "a b"


def test_limits():
    assert candidate_limit(1) == 50 and candidate_limit(30) == 150 and candidate_limit(1000) == 1000
    for bad in (0, 1001):
        with pytest.raises(SearchError):
            check_limit(bad)


def test_fold():
    assert fold_query("Café foo_bar RÉSUMÉ Straße ệ") == ["cafe", "foo", "bar", "resume", "straße", "ệ"]
