"""Named grok patterns and their expansion to plain regular expressions."""

from __future__ import annotations

import re



def _ipv6() -> str:
    """Address text: n leading groups (7 down to 0), then what may follow that many."""
    group = "[0-9A-Fa-f]{1,4}"
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4 = rf"{octet}(?:\.{octet}){{3}}"
    forms = [rf"(?:{group}:){{7}}(?:{group}|:)", rf"(?:{group}:){{6}}(?::{group}|{v4}|:)"]
    for n in range(5, 0, -1):
        forms.append(
            rf"(?:{group}:){{{n}}}(?:(?::{group}){{1,{7 - n}}}|(?::{group}){{0,{5 - n}}}:{v4}|:)"
        )
    forms.append(rf":(?:(?::{group}){{1,7}}|(?::{group}){{0,5}}:{v4}|:)")
    return "(?:" + "|".join(forms) + ")(?:%.+)?"


# The conventional grok pattern names with their usual meaning.
PATTERNS = {
    # text
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s+",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "QUOTEDSTRING": (
        r"(?:\"[^\\\"]*+(?:\\.[^\\\"]*+)*+\""
        r"|'[^\\']*+(?:\\.[^\\']*+)*+'"
        r"|`[^\\`]*+(?:\\.[^\\`]*+)*+`)"
    ),
    "QS": r"%{QUOTEDSTRING}",
    # numbers
    "INT": r"(?:[+-]?[0-9]+)",
    "BASE10NUM": r"(?<![0-9.+-])(?>[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+))",
    "NUMBER": r"(?:%{BASE10NUM})",
    "BASE16NUM": r"(?<![0-9A-Fa-f])(?:[+-]?(?:0x)?[0-9A-Fa-f]+)",
    "BASE16FLOAT": r"\b(?<![0-9A-Fa-f.])(?:[+-]?(?:0x)?(?:[0-9A-Fa-f]+(?:\.[0-9A-Fa-f]*)?|\.[0-9A-Fa-f]+))\b",
    "POSINT": r"\b(?:[1-9][0-9]*)\b",
    "NONNEGINT": r"\b(?:[0-9]+)\b",
    # network
    "IPV4": r"(?=[0-9])(?<![0-9])(?:(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})(?![0-9])",
    "IPV6": _ipv6(),
    "IP": r"(?:%{IPV4}|%{IPV6})",
    "HOSTNAME": r"\b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*(?:\.?|\b)",
    "HOST": r"%{HOSTNAME}",
    "IPORHOST": r"(?:%{IP}|%{HOSTNAME})",
    "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    # paths and locations
    "PATH": r"(?:%{UNIXPATH}|%{WINPATH})",
    "UNIXPATH": r"(?:/[^/\s]*)+",
    "WINPATH": r"(?:[A-Za-z]:|\\)(?:\\[^\\?*]*)+",
    "TTY": r"(?:/dev/(?:pts|tty(?:[pq])?)(?:\w+)?/?(?:[0-9]+))",
    "URIPROTO": r"[A-Za-z][A-Za-z0-9+\-.]+",
    "URIHOST": r"%{IPORHOST}(?::%{POSINT})?",
    "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%_\-]*)+",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]<>]*",
    "URIPATHPARAM": r"%{URIPATH}(?:%{URIPARAM})?",
    "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    # dates and times
    "MONTH": (
        r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?"
        r"|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b"
    ),
    "MONTHNUM": r"(?:0?[1-9]|1[0-2])",
    "MONTHNUM2": r"(?:0[1-9]|1[0-2])",
    "MONTHDAY": r"(?:(?:0[1-9])|(?:[12][0-9])|(?:3[01])|[1-9])",
    "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)",
    "YEAR": r"(?:\d\d){1,2}",
    "HOUR": r"(?:2[0123]|[01]?[0-9])",
    "MINUTE": r"(?:[0-5][0-9])",
    "SECOND": r"(?:(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?)",
    "TIME": r"(?<![0-9])%{HOUR}:%{MINUTE}(?::%{SECOND})(?![0-9])",
    "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}",
    "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}",
    "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))",
    "ISO8601_SECOND": r"(?:%{SECOND}|60)",
    "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?",
    "DATE": r"(?:%{DATE_US}|%{DATE_EU})",
    "DATESTAMP": r"%{DATE}[- ]%{TIME}",
    "TZ": r"(?:[PMCE][SD]T|UTC)",
    "DATESTAMP_RFC822": r"%{DAY} %{MONTH} %{MONTHDAY} %{YEAR} %{TIME} %{TZ}",
    "DATESTAMP_RFC2822": r"%{DAY}, %{MONTHDAY} %{MONTH} %{YEAR} %{TIME} %{ISO8601_TIMEZONE}",
    "DATESTAMP_OTHER": r"%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{TZ} %{YEAR}",
    "DATESTAMP_EVENTLOG": r"%{YEAR}%{MONTHNUM2}%{MONTHDAY}%{HOUR}%{MINUTE}%{SECOND}",
    # syslog
    "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}",
    "PROG": r"[\w._/%-]+",
    "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?",
    "SYSLOGHOST": r"%{IPORHOST}",
    "SYSLOGFACILITY": r"<%{NONNEGINT:facility}.%{NONNEGINT:priority}>",
    "SYSLOGBASE": r"%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:logsource} %{SYSLOGPROG}:",
    # web servers
    "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}",
    "HTTPDUSER": r"(?:%{EMAILADDRESS}|%{USER})",
    "HTTPDERROR_DATE": r"%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{YEAR}",
    "COMMONAPACHELOG": (
        r"%{IPORHOST:clientip} %{HTTPDUSER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] "
        r"\"(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})\" "
        r"%{NUMBER:response} (?:%{NUMBER:bytes}|-)"
    ),
    "COMBINEDAPACHELOG": r"%{COMMONAPACHELOG} %{QS:referrer} %{QS:agent}",
    # people
    "USER": r"[a-zA-Z0-9._-]+",
    "USERNAME": r"[a-zA-Z0-9._-]+",
    "EMAILLOCALPART": r"[a-zA-Z0-9!#$%&'*+/=?^_`{|}~-]+",
    "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}",
    # levels
    "LOGLEVEL": (
        r"(?:[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo(?:rmation)?|INFO(?:RMATION)?"
        r"|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?"
        r"|[Ff]atal|FATAL|[Ss]evere|SEVERE|[Aa]lert|ALERT|[Ee]merg(?:ency)?|EMERG(?:ENCY)?)"
    ),
}

_REFERENCE = re.compile(r"%\{(\w+)(?::(\w+))?\}")


def expand(pattern: str, custom: dict[str, str] | None = None) -> str:
    """Replace every ``%{NAME}`` / ``%{NAME:field}``; fields become named groups."""
    library = {**PATTERNS, **(custom or {})}

    def unfold(text: str, path: tuple[str, ...]) -> str:
        def one(match: re.Match) -> str:
            name, field = match.groups()
            if name not in library:
                raise ValueError(f"Unknown pattern: {name}")
            if name in path:
                raise ValueError(f"Pattern refers to itself: {name}")
            inner = unfold(library[name], path + (name,))
            return f"(?P<{field}>{inner})" if field else f"(?:{inner})"

        return _REFERENCE.sub(one, text)

    return unfold(pattern, ())
