"""Which protocol a payload looks like: each probe gives a confidence as a column expression, the greatest wins."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wire import uint

# Beginnings of requests and commands, magic numbers, and commands of industrial Ethernet.
HTTP_METHODS = ["GET ", "POST", "PUT ", "DELE", "HEAD", "OPTI", "PATC", "CONN", "TRAC"]
SMTP_COMMANDS = ["EHLO ", "HELO ", "MAIL FROM:", "RCPT TO:", "DATA\r\n", "AUTH ", "STARTTLS\r\n", "QUIT\r\n", "RSET\r\n"]
FTP_COMMANDS = [
    "USER", "PASS", "ACCT", "CWD", "CDUP", "SMNT", "QUIT", "REIN", "PORT", "PASV", "TYPE", "STRU", "MODE", "RETR", "STOR", "STOU", "APPE", "ALLO", "REST", "RNFR",
    "RNTO", "ABOR", "DELE", "RMD", "MKD", "PWD", "LIST", "NLST", "SITE", "SYST", "STAT", "HELP", "NOOP", "FEAT", "SIZE", "MDTM", "EPRT", "EPSV",
]
SIP_METHODS = ["INVITE", "ACK", "BYE", "CANCEL", "OPTIONS", "REGISTER", "PRACK", "SUBSCRIBE", "NOTIFY", "PUBLISH", "INFO", "REFER", "MESSAGE", "UPDATE"]
SMB_MAGICS = ["FF534D42", "FE534D42"]
DHCP_MAGIC, DNP3_START = "63825363", "0564"
ENIP_COMMANDS = [0x0001, 0x0004, 0x0063, 0x0064, 0x0065, 0x0066, 0x006F, 0x0070]


def _text(b: Column, n: int) -> Column:
    """The first n bytes as characters, one each."""
    return F.decode(F.substring(b, F.lit(1), F.lit(n)), "ISO-8859-1")


def _hex(b: Column, at: int, n: int) -> Column:
    return F.hex(F.substring(b, F.lit(at + 1), F.lit(n)))


def _begins(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, c: a | c, [text.startswith(w) for w in words])


def probes(b: Column) -> list[tuple[str, Column]]:
    """(protocol, confidence from 0 to 100) in the order of the registry; of equal confidences the first wins."""
    n = F.octet_length(b)
    first = _text(b, 24)
    upper = F.translate(first, ascii_lowercase, ascii_uppercase)  # bytes, not letters: as a letter, 0xDF would become two
    valid = lambda x: F.is_valid_utf8(x.cast("string"))
    begins_valid = reduce(lambda a, c: a | c, [valid(F.substring(b, F.lit(1), F.lit(n))) for n in range(20, 24)])  # a character of up to 4 bytes may lie across the 20th
    at = lambda i, k=1: uint(b, i, k)
    if_ = lambda test, conf: F.when(test, conf).otherwise(0)
    digits = first.rlike("^[0-9]{3}[ -]")
    padding = at(4) >= 4
    smb = _hex(b, 4, 4).isin(SMB_MAGICS) | _hex(b, 0, 4).isin(SMB_MAGICS)
    little = at(1) * 256 + at(0)
    ike = lambda at_byte: at(at_byte).isin(0x10, 0x20)
    return [
        ("http", if_(((n >= 4) & _begins(first, HTTP_METHODS)) | first.startswith("HTTP/"), 100)),
        ("dns", if_((n >= 12) & (at(4, 2) <= 20) & (at(6, 2) <= 50), 70)),
        ("tls", if_((n >= 5) & (at(0) == 22) & at(1, 2).between(0x0300, 0x0304), 100)),
        ("ssh", F.when(first.startswith("SSH-"), 100).otherwise(if_((n >= 5) & at(0, 4).between(1, 262_143) & padding, 90))),
        ("smtp", if_(first.startswith("220 ") | first.startswith("220-") | _begins(upper, SMTP_COMMANDS), 100)),
        ("smb", if_(smb, 100)),
        ("dcerpc", if_((n >= 24) & (at(0) == 5) & at(1).isin(0, 1), 100)),
        ("ftp", if_((n >= 3) & ((valid(b) & _begins(upper, FTP_COMMANDS)) | digits), 90)),
        ("nfs", if_((n >= 28) & (at(4, 4) == 0), 70)),
        ("kerberos", if_((n >= 4) & at(0).between(0x6A, 0x6E), 90)),
        ("rdp", if_((n >= 4) & (at(0) == 3), 80)),
        ("dhcp", if_((n >= 240) & (_hex(b, 236, 4) == DHCP_MAGIC), 100)),
        ("snmp", if_((n >= 10) & (at(0) == 0x30), 80)),
        ("sip", if_(begins_valid & (_begins(upper, SIP_METHODS) | upper.startswith("SIP/")), 100)),
        ("mqtt", if_((n >= 2) & (at(0) >= 16), 70)),
        ("modbus", if_((n >= 8) & (at(2, 2) == 0), 80)),
        ("dnp3", if_((n >= 10) & (_hex(b, 0, 2) == DNP3_START), 90)),
        ("tftp", if_((n >= 4) & at(0, 2).between(1, 6), 80)),
        ("ntp", F.when((n >= 48) & F.shiftright(at(0), 3).bitwiseAND(F.lit(7)).between(1, 4), 85).otherwise(if_((n >= 8) & (at(0).bitwiseAND(F.lit(7)) == 7), 70))),
        ("enip", if_((n >= 24) & little.isin(ENIP_COMMANDS), 85)),
        ("rfb", if_((n >= 12) & first.startswith("RFB "), 100)),
        ("ike", F.when((n >= 28) & ike(17), 90).otherwise(if_((n >= 32) & (at(0, 4) == 0) & ike(21), 85))),
    ]


def best_probe(b: Column) -> Column:
    """struct(protocol, confidence) of the greatest confidence above 0, the earlier of equal ones; null without one."""
    found = [F.struct(F.coalesce(c, F.lit(0)).alias("confidence"), F.lit(-i).alias("order"), F.lit(name).alias("protocol")) for i, (name, c) in enumerate(probes(b))]
    best = F.array_max(F.array(*found))
    return F.when(best["confidence"] > 0, F.struct(best["protocol"].alias("protocol"), best["confidence"].alias("confidence")))
