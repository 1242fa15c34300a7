"""Dictionaries: tag names, enum labels and message names, by protocol version.

A dictionary is loaded from its XML form (`load_xml`), or taken from the small built-in one, which has the tags that the analyses use. A message's
chain of versions follows from its BeginString and ApplVerID; the first version that knows a tag, a value or a type gives its name. Lookups compile to literal
arrays with a place for each tag, so a name costs one access whatever the dictionary's size, and resolving needs no join.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlake.functions.tokens import tag as tag_of

# Names of the public FIX 4.4 specification
FIELDS = {
    6: ("AvgPx", "PRICE"), 7: ("BeginSeqNo", "SEQNUM"), 8: ("BeginString", "STRING"), 9: ("BodyLength", "LENGTH"), 10: ("CheckSum", "STRING"),
    11: ("ClOrdID", "STRING"), 14: ("CumQty", "QTY"), 16: ("EndSeqNo", "SEQNUM"), 17: ("ExecID", "STRING"), 22: ("SecurityIDSource", "STRING"),
    31: ("LastPx", "PRICE"), 32: ("LastQty", "QTY"), 34: ("MsgSeqNum", "SEQNUM"), 35: ("MsgType", "STRING"), 36: ("NewSeqNo", "SEQNUM"),
    37: ("OrderID", "STRING"), 38: ("OrderQty", "QTY"), 39: ("OrdStatus", "CHAR"), 40: ("OrdType", "CHAR"), 41: ("OrigClOrdID", "STRING"),
    43: ("PossDupFlag", "BOOLEAN"), 44: ("Price", "PRICE"), 45: ("RefSeqNum", "SEQNUM"), 48: ("SecurityID", "STRING"), 49: ("SenderCompID", "STRING"),
    50: ("SenderSubID", "STRING"), 52: ("SendingTime", "UTCTIMESTAMP"), 54: ("Side", "CHAR"), 55: ("Symbol", "STRING"), 56: ("TargetCompID", "STRING"),
    57: ("TargetSubID", "STRING"), 58: ("Text", "STRING"), 59: ("TimeInForce", "CHAR"), 60: ("TransactTime", "UTCTIMESTAMP"), 97: ("PossResend", "BOOLEAN"),
    98: ("EncryptMethod", "INT"), 108: ("HeartBtInt", "INT"), 112: ("TestReqID", "STRING"), 122: ("OrigSendingTime", "UTCTIMESTAMP"),
    123: ("GapFillFlag", "BOOLEAN"), 141: ("ResetSeqNumFlag", "BOOLEAN"), 150: ("ExecType", "CHAR"), 151: ("LeavesQty", "QTY"), 262: ("MDReqID", "STRING"),
    268: ("NoMDEntries", "NUMINGROUP"), 269: ("MDEntryType", "CHAR"), 270: ("MDEntryPx", "PRICE"), 271: ("MDEntrySize", "QTY"), 279: ("MDUpdateAction", "CHAR"),
}
ENUMS = {
    35: {"0": "HEARTBEAT", "1": "TEST_REQUEST", "2": "RESEND_REQUEST", "3": "REJECT", "4": "SEQUENCE_RESET", "5": "LOGOUT", "8": "EXECUTION_REPORT",
         "9": "ORDER_CANCEL_REJECT", "A": "LOGON", "D": "ORDER_SINGLE", "F": "ORDER_CANCEL_REQUEST", "G": "ORDER_CANCEL_REPLACE_REQUEST"},
    39: {"0": "NEW", "1": "PARTIALLY_FILLED", "2": "FILLED", "3": "DONE_FOR_DAY", "4": "CANCELED", "5": "REPLACED", "6": "PENDING_CANCEL", "7": "STOPPED",
         "8": "REJECTED", "9": "SUSPENDED", "A": "PENDING_NEW", "B": "CALCULATED", "C": "EXPIRED", "D": "ACCEPTED_FOR_BIDDING", "E": "PENDING_REPLACE"},
    40: {"1": "MARKET", "2": "LIMIT", "3": "STOP", "4": "STOP_LIMIT", "P": "PEGGED"},
    43: {"N": "ORIGINAL_TRANSMISSION", "Y": "POSSIBLE_DUPLICATE"},
    54: {"1": "BUY", "2": "SELL", "3": "BUY_MINUS", "4": "SELL_PLUS", "5": "SELL_SHORT", "6": "SELL_SHORT_EXEMPT", "7": "UNDISCLOSED", "8": "CROSS",
         "9": "CROSS_SHORT"},
    59: {"0": "DAY", "1": "GOOD_TILL_CANCEL", "2": "AT_THE_OPENING", "3": "IMMEDIATE_OR_CANCEL", "4": "FILL_OR_KILL", "6": "GOOD_TILL_DATE"},
    98: {"0": "NONE_OTHER", "1": "PKCS", "2": "DES", "3": "PKCS_DES", "4": "PGP_DES", "5": "PGP_DES_MD5", "6": "PEM_DES_MD5"},
    141: {"N": "NO", "Y": "YES_RESET_SEQUENCE_NUMBERS"},
    150: {"0": "NEW", "3": "DONE_FOR_DAY", "4": "CANCELED", "5": "REPLACED", "6": "PENDING_CANCEL", "7": "STOPPED", "8": "REJECTED", "9": "SUSPENDED",
          "A": "PENDING_NEW", "B": "CALCULATED", "C": "EXPIRED", "D": "RESTATED", "E": "PENDING_REPLACE", "F": "TRADE", "G": "TRADE_CORRECT",
          "H": "TRADE_CANCEL", "I": "ORDER_STATUS"},
    269: {"0": "BID", "1": "OFFER", "2": "TRADE", "3": "INDEX_VALUE", "4": "OPENING_PRICE", "5": "CLOSING_PRICE", "6": "SETTLEMENT_PRICE"},
    279: {"0": "NEW", "1": "CHANGE", "2": "DELETE"},
}
MESSAGES = {
    "0": "Heartbeat", "1": "TestRequest", "2": "ResendRequest", "3": "Reject", "4": "SequenceReset", "5": "Logout", "8": "ExecutionReport",
    "9": "OrderCancelReject", "A": "Logon", "D": "NewOrderSingle", "F": "OrderCancelRequest", "G": "OrderCancelReplaceRequest", "H": "OrderStatusRequest",
    "V": "MarketDataRequest", "W": "MarketDataSnapshotFullRefresh", "X": "MarketDataIncrementalRefresh", "Y": "MarketDataRequestReject",
    "j": "BusinessMessageReject", "c": "SecurityDefinitionRequest", "d": "SecurityDefinition",
}
# The session layer of the public FIXT 1.1 specification
SESSION_FIELDS = {
    7: ("BeginSeqNo", "SEQNUM"), 8: ("BeginString", "STRING"), 9: ("BodyLength", "LENGTH"), 10: ("CheckSum", "STRING"), 16: ("EndSeqNo", "SEQNUM"), 34: ("MsgSeqNum", "SEQNUM"),
    35: ("MsgType", "STRING"), 36: ("NewSeqNo", "SEQNUM"), 43: ("PossDupFlag", "BOOLEAN"), 45: ("RefSeqNum", "SEQNUM"), 49: ("SenderCompID", "STRING"),
    50: ("SenderSubID", "STRING"), 52: ("SendingTime", "UTCTIMESTAMP"), 56: ("TargetCompID", "STRING"), 57: ("TargetSubID", "STRING"), 58: ("Text", "STRING"),
    89: ("Signature", "DATA"), 90: ("SecureDataLen", "LENGTH"), 91: ("SecureData", "DATA"), 93: ("SignatureLength", "LENGTH"), 95: ("RawDataLength", "LENGTH"),
    96: ("RawData", "DATA"), 97: ("PossResend", "BOOLEAN"), 98: ("EncryptMethod", "INT"), 108: ("HeartBtInt", "INT"), 112: ("TestReqID", "STRING"),
    115: ("OnBehalfOfCompID", "STRING"), 116: ("OnBehalfOfSubID", "STRING"), 122: ("OrigSendingTime", "UTCTIMESTAMP"), 123: ("GapFillFlag", "BOOLEAN"),
    128: ("DeliverToCompID", "STRING"), 129: ("DeliverToSubID", "STRING"), 141: ("ResetSeqNumFlag", "BOOLEAN"), 142: ("SenderLocationID", "STRING"),
    143: ("TargetLocationID", "STRING"), 144: ("OnBehalfOfLocationID", "STRING"), 145: ("DeliverToLocationID", "STRING"), 212: ("XmlDataLen", "LENGTH"),
    213: ("XmlData", "DATA"), 347: ("MessageEncoding", "STRING"), 354: ("EncodedTextLen", "LENGTH"), 355: ("EncodedText", "DATA"), 369: ("LastMsgSeqNumProcessed", "SEQNUM"),
    371: ("RefTagID", "INT"), 372: ("RefMsgType", "STRING"), 373: ("SessionRejectReason", "INT"), 383: ("MaxMessageSize", "LENGTH"), 384: ("NoMsgTypes", "NUMINGROUP"),
    385: ("MsgDirection", "CHAR"), 464: ("TestMessageIndicator", "BOOLEAN"), 553: ("Username", "STRING"), 554: ("Password", "STRING"), 627: ("NoHops", "NUMINGROUP"),
    628: ("HopCompID", "STRING"), 629: ("HopSendingTime", "UTCTIMESTAMP"), 630: ("HopRefID", "SEQNUM"), 789: ("NextExpectedMsgSeqNum", "SEQNUM"), 925: ("NewPassword", "STRING"),
    1128: ("ApplVerID", "STRING"), 1129: ("CstmApplVerID", "STRING"), 1130: ("RefApplVerID", "STRING"), 1131: ("RefCstmApplVerID", "STRING"), 1137: ("DefaultApplVerID", "STRING"),
    1156: ("ApplExtID", "INT"), 1400: ("EncryptedPasswordMethod", "INT"), 1401: ("EncryptedPasswordLen", "LENGTH"), 1402: ("EncryptedPassword", "DATA"),
    1403: ("EncryptedNewPasswordLen", "LENGTH"), 1404: ("EncryptedNewPassword", "DATA"), 1406: ("RefApplExtID", "INT"), 1407: ("DefaultApplExtID", "INT"),
    1408: ("DefaultCstmApplVerID", "STRING"), 1409: ("SessionStatus", "INT"), 1410: ("DefaultVerIndicator", "BOOLEAN"),
}
SESSION_MESSAGES = {
    "0": "Heartbeat", "1": "TestRequest", "2": "ResendRequest", "3": "Reject", "4": "SequenceReset", "5": "Logout", "A": "Logon", "n": "XMLnonFIX",
}
#: Fields that an application version has beyond those of the one before it.
ADDED = {"FIX50SP1": {1180: ("ApplID", "STRING")}, "FIX50SP2": {1180: ("ApplID", "STRING"), 1301: ("MarketID", "EXCHANGE")}}
# Counters of repeating groups, with the tags that may stand in their entries
GROUPS = {
    268: (55, 48, 22, 207, 461, 269, 270, 271, 272, 273, 274, 275, 276, 277, 278, 279, 280, 282, 283, 284, 285, 286, 287, 288, 289, 290, 291, 292, 293, 294,
          336, 432, 625, 828, 1023),
}
#: ApplVerID to the version that follows FIXT11 in the chain.
APPLICATION_VERSIONS = {"6": "FIX44", "7": "FIX50", "8": "FIX50SP1"}
# Short names of sides in tables
SIDES = {"1": "BUY", "2": "SELL", "3": "BUYM", "4": "SELLS", "5": "SELLSE", "6": "SELLSX", "7": "UNDISC", "8": "CROSS", "9": "CROSSS"}


@dataclass
class Dictionary:
    """Of each version: fields {tag: (name, type)}, enums {tag: {value: label}}, messages {type: name}."""

    fields: dict[str, dict[int, tuple[str, str]]] = field(default_factory=dict)
    enums: dict[str, dict[int, dict[str, str]]] = field(default_factory=dict)
    messages: dict[str, dict[str, str]] = field(default_factory=dict)

    def add(self, version: str, fields: dict, enums: dict, messages: dict) -> Dictionary:
        self.fields[version], self.enums[version], self.messages[version] = fields, enums, messages
        return self

    def sizes(self, spark: SparkSession) -> DataFrame:
        """(version, fields, messages)."""
        return spark.createDataFrame([(v, len(self.fields[v]), len(self.messages[v])) for v in sorted(self.fields)], "version string, fields int, messages int")

    def field_name(self, chain: list[str], tag: int) -> str | None:
        return next((self.fields[v][tag][0] for v in chain if tag in self.fields.get(v, {})), None)

    def label(self, chain: list[str], tag: int, value: str) -> str | None:
        return next((found for v in chain if (found := self.enums.get(v, {}).get(tag, {}).get(value))), None)

    def message_name(self, chain: list[str], kind: str) -> str | None:
        return next((self.messages[v][kind] for v in chain if kind in self.messages.get(v, {})), None)


def builtin() -> Dictionary:
    """The fields, values and messages that the analyses use: FIX44 has all of them, FIXT11 the session layer, and the others the application layer."""
    session_only = set(SESSION_FIELDS) - {58, 347, 354, 355, 371, 372}
    application = {t: f for t, f in FIELDS.items() if t not in session_only}
    messages = {k: name for k, name in MESSAGES.items() if k not in SESSION_MESSAGES}
    pick = lambda fields: {t: ENUMS[t] for t in fields if t in ENUMS}
    found = Dictionary().add("FIX44", FIELDS, ENUMS, MESSAGES).add("FIXT11", SESSION_FIELDS, pick(SESSION_FIELDS), SESSION_MESSAGES)
    for version in ("FIX50", "FIX50SP1", "FIX50SP2"):
        fields = application | ADDED.get(version, {})
        found.add(version, fields, pick(fields), messages)
    return found


def load_xml(text: str) -> tuple[dict, dict, dict]:
    """Fields, enums and messages of a dictionary's XML; a field without a type is a STRING, of a message type's names the first counts."""
    root, fields, enums, messages = ET.fromstring(text), {}, {}, {}
    for f in root.iterfind("./fields/field"):
        number = int(f.get("number"))
        fields.setdefault(number, (f.get("name"), f.get("type") or "STRING"))
        values = {v.get("enum"): v.get("description") for v in f.iterfind("value")}
        if values:
            enums.setdefault(number, values)
    for m in root.iterfind("./messages/message"):
        messages.setdefault(m.get("msgtype"), m.get("name"))
    return fields, enums, messages


def chain_for(begin_string: str | None, application_version: str | None) -> list[str]:
    if begin_string != "FIXT.1.1":
        return ["FIX44"]
    return ["FIXT11", APPLICATION_VERSIONS.get(application_version or "", "FIX50SP2")]


def chain_column(begin: Column | None = None, application: Column | None = None) -> Column:
    """The chain as a Column: array<string>."""
    begin, application = begin if begin is not None else tag_of(8), application if application is not None else tag_of(1128)
    after = F.lit("FIX50SP2")
    for value, version in APPLICATION_VERSIONS.items():
        after = F.when(application == value, F.lit(version)).otherwise(after)
    return F.when(begin == "FIXT.1.1", F.array(F.lit("FIXT11"), after)).otherwise(F.array(F.lit("FIX44")))


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(entries: dict[str, str]) -> str:
    return f"map({', '.join(_text(x) for kv in entries.items() for x in kv)})" if entries else "CAST(map() AS MAP<STRING, STRING>)"


def _indexed(entries: dict[int, str], kind: str) -> str:
    """SQL of a literal array with a place for each tag."""
    return f"CAST(array({', '.join(entries.get(t, 'NULL') for t in range(max(entries, default=0) + 1))}) AS ARRAY<{kind}>)"


def _by_version(tables: dict[str, Column], chain: Column) -> Column:
    """The first version of the chain that has the key."""
    at = lambda i: F.coalesce(*[F.when(F.get(chain, F.lit(i)) == v, c) for v, c in tables.items()])
    return F.coalesce(at(0), at(1))


def name_column(tag: Column, chain: Column, d: Dictionary, part: int = 0) -> Column:
    found = {v: F.get(F.expr(_indexed({t: _text(x[part]) for t, x in f.items()}, "STRING")), tag.try_cast("int")) for v, f in d.fields.items()}
    return _by_version(found, chain)


def label_column(tag: Column, value: Column, chain: Column, d: Dictionary) -> Column:
    found = {
        v: F.try_element_at(F.get(F.expr(_indexed({t: _map(values) for t, values in e.items()}, "MAP<STRING, STRING>")), tag.try_cast("int")), value)
        for v, e in d.enums.items()
    }
    return _by_version(found, chain)


def message_name_column(kind: Column, chain: Column, d: Dictionary) -> Column:
    return _by_version({v: F.try_element_at(F.expr(_map(m)), kind) for v, m in d.messages.items()}, chain)


def depth_column(tags: str = "tags", pos: Column | None = None, groups: dict = GROUPS) -> Column:
    """1 for a tag inside an open group, else 0: the last tag before it that cannot be a member is the group's counter."""
    def of(counter: int, members: tuple[int, ...]) -> Column:
        outside = F.filter(tags, lambda t: ~t["tag"].isin(*members) & (t["pos"] < pos))
        inside = F.get(F.filter(tags, lambda t: t["pos"] == pos), F.lit(0))["tag"].isin(*members)
        return inside & (F.try_element_at(outside, F.lit(-1))["tag"] == counter)

    found = F.lit(False)
    for counter, members in groups.items():
        found = found | of(counter, members)
    return F.coalesce(found, F.lit(False)).cast("int")


def resolve(messages: DataFrame, d: Dictionary | None = None, chain: list[str] | None = None) -> DataFrame:
    """Add msg_type_name and fields: array<struct<pos, tag, name, field_type, value, value_label, depth>> to messages with a tags column."""
    d = d or builtin()
    out = messages.withColumn("_chain", F.array(*map(F.lit, chain)) if chain else chain_column())
    of = F.col("_chain")
    resolved = F.transform("tags", lambda t: F.struct(
        t["pos"].alias("pos"), t["tag"].alias("tag"), name_column(t["tag"], of, d).alias("name"), name_column(t["tag"], of, d, 1).alias("field_type"),
        t["value"].alias("value"), label_column(t["tag"], t["value"], of, d).alias("value_label"), depth_column("tags", t["pos"]).alias("depth"),
    ))
    kind = F.get(F.filter("tags", lambda t: t["tag"] == 35), F.lit(0))["value"]
    return out.withColumn("msg_type_name", message_name_column(kind, of, d)).withColumn("fields", resolved).drop("_chain")
