"""The address rules, on addresses of an invented river authority."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from newsloom.functions.urls import canonicalize_url, extract_domain

ROOT = "https://river-desk.test"


@pytest.mark.parametrize("spelling", ["https://river-desk.test/locks/7", "HTTPS://www.River-Desk.test/locks/7/", "//river-desk.test/locks/7", "river-desk.test/locks/7#gate", "https://river-desk.test.:443/locks/7?", "https://river-desk.test/locks/%37"])
def test_spellings_of_one_address(spelling):
    assert canonicalize_url(spelling) == f"{ROOT}/locks/7"


@pytest.mark.parametrize("extra", ["utm_term=weir", "UTM_WHATEVER=1", "gclid=9&mc_eid=4", "share=mail", "empty="])
def test_parameters_that_say_nothing(extra):
    assert canonicalize_url(f"{ROOT}/levels?gauge=12&{extra}") == f"{ROOT}/levels?gauge=12"


def test_what_stays_apart():
    assert canonicalize_url(f"{ROOT}/levels?z=1&gauge=12") == canonicalize_url(f"{ROOT}/levels?gauge=12&z=1")
    kept = [f"{ROOT}:9000/", f"{ROOT}/Locks", f"{ROOT}/locks", "http://river-desk.test/locks", "http://river-desk.test:443/locks", f"{ROOT}/levels?gauge=12", f"{ROOT}/a%20b"]
    assert [canonicalize_url(x) for x in kept] == kept
    assert canonicalize_url(f"{ROOT}/levels?gauge=12", strip_query=True) == f"{ROOT}/levels"


@pytest.mark.parametrize("page", ["index.html", "index.htm", "index.php"])
def test_index_pages(page):
    assert canonicalize_url(f"{ROOT}/weirs/{page}") == f"{ROOT}/weirs" and canonicalize_url(f"{ROOT}/{page}") == f"{ROOT}/"


def test_no_address():
    assert [canonicalize_url(x) for x in (None, "", " \t")] == ["", "", ""]
    assert canonicalize_url(" tel://555 ") == "tel://555" and canonicalize_url("https://[::") == "https://[::"
    assert len(canonicalize_url(f"{ROOT}/" + "w" * 5000)) == 2048


@given(st.text(max_size=60))
def test_canonical_form_is_stable(text):
    once = canonicalize_url(f"{ROOT}/" + text)
    assert canonicalize_url(once) == once


def test_domain():
    assert extract_domain("https://www.Weir.test/x") == "weir.test" and extract_domain("weir.test") == "weir.test" and extract_domain(None) == ""
