"""Further classifiers, enrichment, protobuf profiles and tools, over inline relations and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import protocols as N
from ..functions.text import in_cidr
from ..operators import endpoints as P
from ..operators import enrich, protobuf, tools
from ..sources.captures import tables
from .content import values
from .registry import query
from .web import _BASE, _TEMPLATES, reqs

_TYPES = "('application/json; charset=utf-8', 'json'), ('TEXT/HTML', 'html'), ('image/png', 'png'), ('application/problem+json', 'json'), ('application/x-odd', 'bin'), ('text/yaml', 'yaml'), ('image/jpg', 'jpg'), ('image/vnd.microsoft.icon', 'ico'), ('video/webm', 'webm'), ('text/event-stream', 'sse'), ('application/grpc+proto', 'grpc'), ('application/x-tar', 'tar'), ('audio/ogg', 'ogg'), ('image/avif', 'avif'), ('', 'bin')"


@query(f"SELECT content_type, ext FROM (VALUES {_TYPES}) AS t(content_type, ext)")
def guess_extension(spark, sf_dir):
    return values(spark, "content_type, ext", _TYPES).select("content_type", C.extension(F.col("content_type")).alias("ext"))


_GRPC = "('/my.Svc/DoThing', 'my.Svc', 'DoThing'), ('/users/1/x', NULL, NULL), ('/only', NULL, NULL)"


@query(f"SELECT path, service, method FROM (VALUES {_GRPC}) AS t(path, service, method)")
def grpc_split(spark, sf_dir):
    return values(spark, "path, service, method", _GRPC).select("path", C.grpc_call(F.col("path")).alias("g")).select("path", "g.service", "g.method")


_SOCKETIO = """('42["chat",{"a":1}]', 'chat'), ('42/admin,7["join"]', 'join'), ('40', NULL), ('2probe', NULL)"""


@query(f"SELECT frame, event FROM (VALUES {_SOCKETIO}) AS t(frame, event)")
def socketio_events(spark, sf_dir):
    return values(spark, "frame, event", _SOCKETIO).select("frame", C.socketio_event(F.col("frame")).alias("event"))


_DOM, _USR, _HOST = "CORP".encode("utf-16-le"), "ann".encode("utf-16-le"), "PC1".encode("utf-16-le")
_NTLM3 = b"xx" + b"NTLMSSP\0" + (3).to_bytes(4, "little") + bytes(16) + b"".join(len(x).to_bytes(2, "little") * 2 + at.to_bytes(4, "little") for x, at in ((_DOM, 64), (_USR, 64 + len(_DOM)), (_HOST, 64 + len(_DOM) + len(_USR)))) + bytes(8) + (1).to_bytes(4, "little") + _DOM + _USR + _HOST
_NTLM = f"('{_NTLM3.hex()}', 3, 'CORP', 'ann', 'PC1'), ('{(b'NTLMSSP' + bytes(1) + (1).to_bytes(4, 'little') + bytes(4)).hex()}', 1, NULL, NULL, NULL), ('00ff', NULL, NULL, NULL, NULL)"


@query(f"SELECT payload, type, domain, usr, host FROM (VALUES {_NTLM}) AS t(payload, type, domain, usr, host)")
def ntlm_messages(spark, sf_dir):
    found = values(spark, "payload, type, domain, usr, host", _NTLM).select("payload", C.ntlm(F.unhex("payload")).alias("n"))
    return found.select("payload", "n.type", "n.domain", F.col("n.user").alias("usr"), "n.host")


_DNS = "('123401000001000000000000076578616d706c6503636f6d0000010001', 4660, 'example.com', 'A', false), ('0001818300010000000000000161026d780000ff0001', 1, 'a.mx', 'ANY', true), ('00', NULL, NULL, NULL, NULL)"


@query(f"SELECT payload, id, name, type, is_response FROM (VALUES {_DNS}) AS t(payload, id, name, type, is_response)")
def dns_questions(spark, sf_dir):
    own = values(spark, "payload, id, name, type, is_response", _DNS)
    return own.select("payload", N.dns_question(F.unhex("payload")).alias("q")).select("payload", "q.id", "q.name", "q.type", "q.is_response")


_MARKS = "(0, '16030100', 'tls'), (0, '474554202f20485454502f312e310d0a', 'http1'), (6379, '00000000', 'redis'), (0, '2a310d0a2450494e47', 'redis'), (0, '0000000804d2162f', 'postgres'), (0, '7a7a7a7a', 'unknown')"


@query("SELECT port, payload, l7 FROM (VALUES (0, '1603010005', 'tls'), (0, '474554202f20485454502f312e310d0a', 'http1'), (6379, '00000000', 'redis'), (0, '2a310d0a2450494e47', 'redis'), (0, '0000000804d2162f', 'postgres'), (0, '7a7a7a7a', 'unknown')) AS t(port, payload, l7)")
def protocol_detection(spark, sf_dir):
    own = values(spark, "port, payload, l7", _MARKS.replace("16030100", "1603010005"))
    return own.select("port", "payload", N.detect(F.col("port"), F.unhex("payload"), F.lit(b"")).alias("l7"))


_PROTO = "(1, '082a1007'), (2, '0a0568656c6c6f0801'), (3, '0a0568656c6c6f0a0577' || '6f726c64'), (4, 'ff'), (5, '1a020801')"


@query("SELECT tag, type, repeated, messages FROM (VALUES (1, 'string', true, 3), (2, 'int32', false, 1), (3, 'Message_3', false, 1)) AS t(tag, type, repeated, messages)")
def proto_profile(spark, sf_dir):
    samples = values(spark, "sample, hex", _PROTO).select("sample", F.unhex("hex").alias("content"))
    fields = protobuf.profile(protobuf.decoded(samples))
    return fields.select("tag", "type", "repeated", F.col("messages").cast("int").alias("messages"))


@query("SELECT c_custkey, n_name AS container, CASE WHEN n_regionkey = 1 THEN 'docker' ELSE 'podman' END AS runtime FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def container_enrichment(spark, sf_dir):
    customer, nation = tables(spark, sf_dir, "customer", "nation")
    dims = nation.select(F.col("n_nationkey").alias("cgroup_id"), F.col("n_name").alias("container"), F.when(F.col("n_regionkey") == 1, "docker").otherwise("podman").alias("runtime"))
    return enrich.with_containers(customer.withColumnRenamed("c_nationkey", "cgroup_id"), dims).select("c_custkey", "container", "runtime")


_PODS = "('shop_cart-5d_1a-2b', 'shop', 'cart-5d', '1a-2b'), ('kube-system_dns_x_9', 'kube-system', 'dns_x', '9')"


@query(f"SELECT namespace, pod, uid FROM (VALUES {_PODS}) AS t(name, namespace, pod, uid)")
def pod_folders(spark, sf_dir):
    return enrich.pod_names(values(spark, "name, a, b, c", _PODS + ", ('odd', '', '', '')"))


_CATALOGUE = f"""WITH {_BASE}, {_TEMPLATES}, cat AS (SELECT host, template, count(*) AS calls, CAST(sum(size) // count(*) AS BIGINT) AS avg_bytes, round(quantile_cont(size, 0.5), 3) AS p50, round(quantile_cont(size, 0.99), 3) AS p99 FROM shaped JOIN tpl USING (host, shape) GROUP BY host, shape, template)"""


def catalogue(spark, sf_dir):
    own = reqs(spark, sf_dir)
    sums = own.groupBy("host", "shape").agg(F.count("*").alias("calls"), F.floor(F.sum("size") / F.count("*")).cast("long").alias("avg_bytes"), F.round(F.percentile("size", F.lit(0.5)), 3).alias("p50"), F.round(F.percentile("size", F.lit(0.99)), 3).alias("p99"))
    return sums.join(P.templates(own), ["host", "shape"]).select("host", "template", "calls", "avg_bytes", "p50", "p99")


@query(f"{_CATALOGUE} SELECT host, template, calls, avg_bytes, p50, p99 FROM cat ORDER BY p99 DESC, host, template LIMIT 20")
def tool_list_endpoints(spark, sf_dir):
    return tools.list_endpoints(catalogue(spark, sf_dir), "p99", 20)


@query(f"{_CATALOGUE} SELECT count(*) AS endpoints, count(DISTINCT host) AS hosts, CAST(sum(calls) AS BIGINT) AS calls, min(p99) AS least_p99, max(p99) AS most_p99 FROM cat")
def tool_catalog_stats(spark, sf_dir):
    return tools.catalog_stats(catalogue(spark, sf_dir))


@query("SELECT r_name, r_regionkey FROM region WHERE 3232235520 + r_regionkey * 256 BETWEEN 3232235776 AND 3232236287")
def cidr_of_numbers(spark, sf_dir):
    (region,) = tables(spark, sf_dir, "region")
    ip = F.concat(F.lit("192.168."), F.col("r_regionkey").cast("string"), F.lit(".0"))
    return region.where(in_cidr(ip, "192.168.1.0/24") | in_cidr(ip, "192.168.2.0/24")).select("r_name", "r_regionkey")
