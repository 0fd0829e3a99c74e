"""SQL pieces for the oracle texts, the same functions as in ``functions``."""

from __future__ import annotations

from ..functions import text as T
from ..functions import urls as U


def q(pattern: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def outer(x: str) -> str:
    return f"regexp_replace({x},{q(f'^{T.WHITE}+|{T.WHITE}+$')},'','g')"


def fold(x: str) -> str:
    for a, b in T.FOLD_PAIRS:
        x = f"replace({x},{q(a)},{q(b)})"
    return f"translate({x},{q(T.FOLD_FROM)},{q(T.FOLD_TO)})"


def clean(x: str) -> str:
    return f"trim(regexp_replace(lower({fold(x)}),{q(T.WHITE + '+')},' ','g'))"


def slug(x: str) -> str:
    return f"regexp_replace(lower({fold(x)}),'[^a-z0-9]','','g')"


def title_case(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x},'(\\p{{L}}+|[^\\p{{L}}]+)',1), lambda p: upper(substr(p,1,1))||lower(substr(p,2))),'')"


def strip_corporate(x: str) -> str:
    x = outer(x)
    for _ in range(3):
        x = f"regexp_replace(regexp_replace({x},{q(T.CORP_PATTERN)},''),{q(f'^({T.WHITE}|[,&.])+|({T.WHITE}|[,&.])+$')},'','g')"
    return f"coalesce({x},'')"


def normal_model(x: str) -> str:
    return f"upper(regexp_replace(regexp_replace(regexp_replace({outer(x)},{q(T.WHITE + '+')},' ','g'),'[–—]','-','g'),'\\s*-\\s*','-','g'))"


def price(x: str) -> str:
    d = f"regexp_replace({x},'[^0-9,.]','','g')"
    n = f"case when regexp_matches({d},{q(T.COMMA_DECIMAL)}) then translate({d},',.','.') else translate({d},',','') end"
    return f"case when regexp_matches({n},{q(T.PLAIN_NUMBER)}) then try_cast({n} as double) end"


def authority(x: str) -> str:
    return f"nullif(lower(regexp_extract({x},'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)',1)),'')"


def origin(x: str) -> str:
    return f"regexp_extract({x},'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)',1)"


def host_key(x: str) -> str:
    return f"regexp_replace(lower(trim({x})),'^(www\\.|m\\.)','')"


def path(x: str) -> str:
    return f"regexp_extract({x},'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)',1)"


def path_pattern(x: str) -> str:
    return f"array_to_string(list_transform(string_split(regexp_replace({path(x)},'/+$',''),'/'), lambda s: case when regexp_matches(s,'[0-9-]') or length(s)>20 then '{{slug}}' else s end),'/')"


def is_product(x: str) -> str:
    return f"regexp_matches({path(x)},{q(U.PRODUCT_PATTERN)})"


def is_skipped(x: str) -> str:
    return f"regexp_matches({path(x)},{q(U.SKIP_PATTERN)})"


def is_english(x: str) -> str:
    return f"regexp_matches({x},{q(U.ENGLISH_PATTERN)})"
