"""Content classifiers and scalar functions over the driver's tables and small inline relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..sources.captures import tables
from .registry import query

_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def values(spark, names: str, rows: str):
    """A small relation from SQL literals."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


@query(" UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, CAST(len(regexp_extract_all(text, '{shape.replace(chr(39), chr(39) * 2)}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{shape.replace(chr(39), chr(39) * 2)}')" for name, shape in C.SECRETS.items()))
def secret_scan(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    counts = F.array(*(F.struct(F.lit(name).alias("rule"), F.regexp_count("text", F.lit(shape)).cast("long").alias("n")) for name, shape in C.SECRETS.items()))
    return docs.select("doc_id", F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("f")).select("doc_id", "f.rule", "f.n")


_KEYS = "('Authorization'), ('api-key'), ('X-Tenant'), ('cc_num'), ('session_token'), ('page'), ('SSN'), ('user')"


@query(f"SELECT name, regexp_matches(name, '{C.SECRET_KEY}') AS secret FROM (VALUES {_KEYS}) AS t(name)")
def secret_key_flags(spark, sf_dir):
    return values(spark, "name", _KEYS).select("name", F.col("name").rlike(C.SECRET_KEY).alias("secret"))


def _mask(sql: str) -> str:
    for name, shape in C.SECRETS.items():
        sql = f"regexp_replace({sql}, '{shape.replace(chr(39), chr(39) * 2)}', '<{name}>', 'g')"
    sql = f"regexp_replace({sql}, '{_MAIL}', '<email>', 'g')"
    return f"regexp_replace({sql}, '[0-9](?:[ -]*[0-9]){{12,18}}', '<number>', 'g')"


@query(f"SELECT doc_id, sha256({_mask('text')}) AS masked_sha256 FROM documents")
def redact_text(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(C.redacted(F.col("text")), 256).alias("masked_sha256"))


_LUHN = "list_sum(list_transform(range(len({0})), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN 2 * CAST({0}[len({0}) - i] AS INTEGER) > 9 THEN 2 * CAST({0}[len({0}) - i] AS INTEGER) - 9 ELSE 2 * CAST({0}[len({0}) - i] AS INTEGER) END) ELSE CAST({0}[len({0}) - i] AS INTEGER) END)) % 10 = 0"


@query(f"SELECT doc_id, run, {_LUHN.format('run')} AS luhn FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[0-9](?:[ -]*[0-9]){{12,}}')), '[ -]', '', 'g') AS run FROM documents)")
def card_luhn(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(C.card_candidates(F.col("text"))).alias("run")).withColumn("luhn", C.luhn(F.col("run")))


_PII = "('my ssn is 219-09-9999.', true, false, false), ('000-12-3456', false, false, false), ('1219-09-9999', false, false, false), ('pay GB82WEST12345698765432 now', false, true, false), ('XGB82WEST12345698765432', false, false, false), ('card 4111 1111 1111 1111', false, false, true), ('4111-1111-1111-1112', false, false, false), ('nothing here', false, false, false)"


@query(f"SELECT text, ssn, iban, card FROM (VALUES {_PII}) AS t(text, ssn, iban, card)")
def pii_vectors(spark, sf_dir):
    own = values(spark, "text, ssn, iban, card", _PII)
    return own.select("text", C.has_ssn(F.col("text")).alias("ssn"), C.has_iban(F.col("text")).alias("iban"), C.has_card(F.col("text")).alias("card"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)') AS ssn, regexp_matches(text, '(^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Za-z0-9]{11,30}([^A-Za-z0-9]|$)') AS iban FROM documents")
def ssn_iban_flags(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", C.has_ssn(F.col("text")).alias("ssn"), C.has_iban(F.col("text")).alias("iban"))


_LLM = """('POST', '/v1/messages', 'api.anthropic.com', '{"model":"m-1","stream":true}', 'anthropic', 'm-1'), ('POST', '/v1/chat/completions', 'api.openai.com', '{"model": "g"}', 'openai', 'g'),
 ('POST', '/v1/chat/completions', 'llm.internal', '{}', 'openai_compatible', NULL), ('POST', '/v1beta/models/x:generateContent', 'generativelanguage.googleapis.com', '{}', 'gemini', NULL),
 ('POST', '/openai/deployments/d/chat/completions?api-version=1', 'x.openai.azure.com', '{}', 'azure_openai', NULL), ('POST', '/model/a.b/invoke', 'bedrock-runtime.eu-west-1.amazonaws.com', '{}', 'bedrock', NULL),
 ('POST', '/api/chat', 'localhost', '{"model":"l"}', 'ollama', 'l'), ('GET', '/v1/messages', 'api.anthropic.com', '', NULL, NULL), ('POST', '/users', 'x', '{}', NULL, NULL)"""


@query(f"SELECT method, path, host, provider, model FROM (VALUES {_LLM}) AS t(method, path, host, body, provider, model)")
def llm_classify(spark, sf_dir):
    own = values(spark, "method, path, host, body, provider, model", _LLM)
    return own.select("method", "path", "host", C.llm_provider(F.col("method"), F.col("path"), F.col("host")).alias("provider"), C.llm_model(F.col("body")).alias("model"))


_AWS = """('bucket.s3.eu-west-1.amazonaws.com', '', '', 'GET', true, 's3', 'GetObject'), ('s3.amazonaws.com', '', '', 'PUT', false, 's3', 'CreateBucket'), ('dynamodb.us-east-1.amazonaws.com', '', '', 'POST', true, 'dynamodb', 'PostObject'),
 ('internal', '', 'AWS4-HMAC-SHA256 Credential=AKIA/20240101/us-east-1/sqs/aws4_request', 'HEAD', true, 'sqs', 'HeadObject'), ('internal', 'Logs_20140328.PutLogEvents', '', 'DELETE', false, 'logs', 'DeleteBucket'), ('example.com', '', '', 'POST', false, NULL, NULL)"""


@query(f"SELECT host, method, service, op FROM (VALUES {_AWS}) AS t(host, target, auth, method, has_key, service, op)")
def aws_classify(spark, sf_dir):
    own = values(spark, "host, target, auth, method, has_key, service, op", _AWS)
    return own.select("host", "method", C.aws_service(F.col("host"), F.col("target"), F.col("auth")).alias("service"), C.s3_operation(F.col("method"), F.col("has_key")).alias("op"))


_GRAPHQL = """('{"query":"query Me { me { id } }"}', 'query', 'Me'), ('{"query":"{ me { id } }"}', 'query', NULL), ('{"query":"mutation Add($a: Int) { add(a: $a) }"}', 'mutation', 'Add'), ('{"query":"subscription { tick }"}', 'subscription', NULL), ('{"a":1}', NULL, NULL)"""


@query(f"SELECT body, kind, name FROM (VALUES {_GRAPHQL}) AS t(body, kind, name)")
def graphql_classify(spark, sf_dir):
    own = values(spark, "body, kind, name", _GRAPHQL)
    return own.select("body", C.graphql_kind(F.col("body")).alias("kind"), C.graphql_name(F.col("body")).alias("name"))


_HEX = "0123456789abcdef" * 4
_CGROUPS = f"('/system.slice/docker-{_HEX}.scope', 'docker', '0123456789ab'), ('/docker/{_HEX}', 'docker', '0123456789ab'), ('/kubepods/burstable/pod1/cri-containerd-{_HEX}.scope', 'containerd', '0123456789ab'), ('/kubepods/pod1/crio-{_HEX}.scope', 'cri-o', '0123456789ab'), ('/machine.slice/libpod-{_HEX}.scope', 'podman', '0123456789ab'), ('/system.slice/nginx.service', 'systemd', 'nginx'), ('/user.slice', NULL, NULL)"


@query(f"SELECT cgroup, runtime, name FROM (VALUES {_CGROUPS}) AS t(cgroup, runtime, name)")
def container_classify(spark, sf_dir):
    own = values(spark, "cgroup, runtime, name", _CGROUPS)
    return own.select("cgroup", C.container_runtime(F.col("cgroup")).alias("runtime"), C.container_name(F.col("cgroup")).alias("name"))


_TLS = "(771, 49199, ''), (769, 47, 'legacy_version,cbc_sha1'), (771, 5, 'rc4'), (771, 1, 'null'), (771, 23, 'export,rc4,anonymous_dh'), (768, 10, 'legacy_version,3des'), (772, 4865, '')"


@query(f"SELECT version, suite, findings FROM (VALUES {_TLS}) AS t(version, suite, findings)")
def tls_hygiene(spark, sf_dir):
    own = values(spark, "version, suite, findings", _TLS)
    return own.select("version", "suite", F.array_join(C.tls_findings(F.col("version"), F.col("suite")), ",").alias("findings"))


_BASIC = "('Basic YWRtaW46YWRtaW4=', 'admin', 'admin', true), ('Basic cm9vdDpzM2NyZXQ6eA==', 'root', 's3cret:x', false), ('Basic Z3Vlc3Q6Z3Vlc3Q', 'guest', 'guest', true), ('Basic $$$$', NULL, NULL, false), ('Bearer abc', NULL, NULL, false)"


@query(f"SELECT header, usr, pass, is_default FROM (VALUES {_BASIC}) AS t(header, usr, pass, is_default)")
def basic_auth_defaults(spark, sf_dir):
    own = values(spark, "header, usr, pass, is_default", _BASIC).select("header")
    text = F.try_validate_utf8(X.base64_strict(F.when(F.col("header").startswith("Basic "), F.substr("header", F.lit(7)))).cast("string"))
    split = own.withColumn("text", text).select("header", F.when(F.instr("text", ":") > 0, F.substring_index("text", ":", 1)).alias("usr"), F.when(F.instr("text", ":") > 0, F.substr("text", F.instr("text", F.lit(":")) + 1)).alias("pass"))
    return split.select("header", "usr", "pass", C.is_default_login(F.col("usr"), F.col("pass")).alias("is_default"))


_ADDR = "('10.0.0.1:40000', '10.0.0.1', 40000), ('[2001:db8::1]:443', '2001:db8::1', 443), ('8.8.8.8:53', '8.8.8.8', 53), ('nonsense', NULL, NULL)"


@query(f"SELECT addr, ip, port FROM (VALUES {_ADDR}) AS t(addr, ip, port)")
def sockaddr_split(spark, sf_dir):
    own = values(spark, "addr, ip, port", _ADDR)
    return own.select("addr", X.host_of(F.col("addr")).alias("ip"), X.port_of(F.col("addr")).alias("port"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def base64_roundtrip(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(X.base64_lenient(F.base64(F.encode("text", "UTF-8"))), 256).alias("sha"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS line_sha256 FROM documents")
def sql_oneline(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(X.one_line(F.col("text")), 256).alias("line_sha256"))


@query(
    """SELECT o_orderkey, n, CASE WHEN n >= 1073741824 THEN (n * 10 // 1073741824) // 10 || '.' || (n * 10 // 1073741824) % 10 || ' GiB' WHEN n >= 1048576 THEN (n * 10 // 1048576) // 10 || '.' || (n * 10 // 1048576) % 10 || ' MiB'
 WHEN n >= 1024 THEN (n * 10 // 1024) // 10 || '.' || (n * 10 // 1024) % 10 || ' KiB' ELSE n || ' B' END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 1000) AS n FROM orders)"""
)
def humanise_bytes(spark, sf_dir):
    (orders,) = tables(spark, sf_dir, "orders")
    own = orders.select("o_orderkey", (F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 1000)).alias("n"))
    return own.withColumn("shown", X.humanised(F.col("n")))


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text")
def sha256_dedup(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, CASE WHEN length(text) > 64 THEN substr(text, 1, 63) || '…' ELSE text END AS preview FROM documents")
def preview_text(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", X.shortened(F.col("text"), 64).alias("preview"))


_PINS = "SELECT sha256(p_name) AS sha FROM part WHERE p_size <= 25"


@query(f"SELECT p_partkey FROM part WHERE sha256(p_name) NOT IN ({_PINS})")
def unpinned_fingerprints(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    prints = part.select("p_partkey", F.sha2("p_name", 256).alias("sha"))
    pins = part.where("p_size <= 25").select(F.sha2("p_name", 256).alias("sha"))
    return prints.join(pins, "sha", "left_anti").select("p_partkey")
