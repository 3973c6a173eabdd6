"""SQL of the id rules that several plans share."""

KEY = "nullif(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')"
BAD = "('NA','NAN','NONE','NULL','UNASSIGNED','UNKNOWN','NIL','MISSING','UNSPECIFIED','TBD','UNDEFINED','NOTAVAILABLE','NOTAPPLICABLE')"


def key(c: str) -> str:
    return KEY.format(c)


def good(c: str) -> str:
    """The key, null for placeholders."""
    return f"CASE WHEN {key(c)} NOT IN {BAD} THEN {key(c)} END"
