"""What a configuration key sets, by its name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, or parts of names, of keys that set something, without signs and in lower case.
SSH_KEYS = ["kexalgorithms", "hostkeyalgorithms", "pubkeyacceptedalgorithms", "pubkeyacceptedkeytypes", "casignaturealgorithms", "macs"]
POLICY_PARTS = ["sslpolicy", "securitypolicy", "tlspolicy"]
SPEC_PARTS = ["keyspec", "masterkeyspec"]
VERSION_PARTS = ["tlsversion", "sslversion", "minversion", "maxversion"]
PROTOCOL_PARTS = ["ssl", "tls", "enabled", "min", "max"]
GROUP_PARTS = ["curve", "namedgroup", "ecdhcurve", "kexgroups"]
ALGORITHM_ENDS = ["hash", "digest", "signature", "kdf", "encryption"]


def normal(key: Column) -> Column:
    """The last part of a dotted key, in lower case and without signs."""
    return F.regexp_replace(F.lower(F.element_at(F.split(key, r"\."), -1)), "[^a-z0-9]", "")


def setting(key: Column) -> Column:
    """protocols, ciphers, groups, ssh, key-spec, tls-policy or algorithm, by the first rule that a normal key meets; null if it sets nothing."""
    is_ = lambda *names: key.isin(list(names))
    any_of = lambda how, parts: reduce(lambda a, b: a | b, (how(key, F.lit(p)) for p in parts))
    has, ends = lambda parts: any_of(F.contains, parts), lambda parts: any_of(F.endswith, parts)
    return (
        F.when(is_(*SSH_KEYS), "ssh").when(has(POLICY_PARTS) | is_("minimumprotocolversion"), "tls-policy").when(has(SPEC_PARTS) | is_("keyalgorithm", "versiontemplatealgorithm"), "key-spec")
        .when(has(["protocol"]) & (has(PROTOCOL_PARTS) | is_("protocols")) | has(VERSION_PARTS), "protocols").when(has(["cipher"]), "ciphers").when(has(GROUP_PARTS) | is_("groups", "tlsgroups"), "groups")
        .when(is_("alg", "algo", "keytype", "mac") | has(["algorithm", "sigalg"]) | ends(ALGORITHM_ENDS), "algorithm")
    )


def of_path(key: Column) -> Column:
    """What a dotted key sets: by its last part, or, for a version below a part that speaks of TLS, the protocols."""
    parts, last = F.transform(F.split(key, r"\."), F.lower), normal(key)
    above = F.slice(parts, 1, F.size(parts) - 1)
    secure = F.exists(above, lambda p: F.contains(p, F.lit("tls")) | F.contains(p, F.lit("ssl")) | (p == "https"))
    return F.coalesce(setting(last), F.when(secure & F.contains(last, F.lit("version")), "protocols"))
