"""Credentials of object stores to Hadoop configuration, and their schemes."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession

from tablelog.errors import InvalidInput

log = logging.getLogger("tablelog")

S3, AZURE, LOCAL = ("s3", "s3a"), ("az", "azure", "abfs", "abfss"), ("", "file")
#: Stores that speak the S3 protocol at an endpoint of their own.
S3_LIKE = {"gs": "storage.googleapis.com", "gcs": "storage.googleapis.com", "r2": None}


def scheme_of(path: str) -> str:
    return path.split("://", 1)[0].lower() if "://" in path else ""


def spark_path(path: str, secret: dict | None = None) -> str:
    """The path under the scheme whose connector reads it."""
    scheme = scheme_of(path)
    rest = path.split("://", 1)[-1]
    if scheme in S3_LIKE:
        if not secret:
            raise InvalidInput("Can not scan a gcs:// gs:// or r2:// url without a secret providing its endpoint; add one for it")
        return f"s3a://{rest}"
    if scheme in S3:
        return f"s3a://{rest}"
    if scheme in ("az", "azure"):
        container, _, inner = rest.partition("/")
        account = (secret or {}).get("account_name")
        return f"abfss://{container}@{account}.dfs.core.windows.net/{inner}" if account else f"abfss://{rest}"
    return path


def hadoop_options(path: str, secret: dict | None) -> dict[str, str]:
    """``fs.*`` settings for a path from a secret's fields."""
    scheme, secret = scheme_of(path), {k.lower(): v for k, v in (secret or {}).items()}
    if scheme in S3 or scheme in S3_LIKE:
        return _s3(path, scheme, secret)
    if scheme in AZURE:
        return _azure(path, secret)
    return {}


def _s3(path: str, scheme: str, secret: dict) -> dict[str, str]:
    bucket = path.split("://", 1)[1].split("/")[0]
    own = f"fs.s3a.bucket.{bucket}"
    key, value = secret.get("key_id", ""), secret.get("secret", "")
    out = {}
    if key or value:
        out |= {f"{own}.access.key": key, f"{own}.secret.key": value}
        provider = "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"
        if secret.get("session_token"):
            out[f"{own}.session.token"] = secret["session_token"]
            provider = "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"
    else:
        provider = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    out[f"{own}.aws.credentials.provider"] = provider
    endpoint = secret.get("endpoint") or S3_LIKE.get(scheme)
    if scheme == "r2" and not endpoint and secret.get("account_id"):
        endpoint = f"{secret['account_id']}.r2.cloudflarestorage.com"
    ssl = secret.get("use_ssl", True)
    if endpoint:
        out[f"{own}.endpoint"] = endpoint if "://" in endpoint else f"{'https' if ssl else 'http'}://{endpoint}"
    if secret.get("region"):
        out[f"{own}.endpoint.region"] = secret["region"]
    out[f"{own}.connection.ssl.enabled"] = str(bool(ssl)).lower()
    out[f"{own}.path.style.access"] = str(secret.get("url_style") == "path").lower()
    return out


def _azure(path: str, secret: dict) -> dict[str, str]:
    rest = path.split("://", 1)[1]
    host = rest.split("/")[0].split("@")[-1]
    pairs = dict(x.split("=", 1) for x in secret.get("connection_string", "").split(";") if "=" in x)
    account = secret.get("account_name") or pairs.get("AccountName") or host.split(".")[0]
    emulator = pairs.get("UseDevelopmentStorage", "").lower() == "true"
    onelake = "onelake" in host
    end = "127.0.0.1:10000" if emulator else "onelake.dfs.fabric.microsoft.com" if onelake else f"{account}.dfs.core.windows.net"
    provider = secret.get("provider", "config")
    if emulator:
        return {"fs.azure.storage.emulator.account.name": account or "devstoreaccount1", f"fs.azure.account.auth.type.{end}": "SharedKey"}
    if secret.get("access_token") or provider == "access_token":
        return {f"fs.azure.account.auth.type.{end}": "Custom", f"fs.azure.account.oauth2.access.token.{end}": secret.get("access_token", "")}
    if pairs.get("AccountKey"):
        return {f"fs.azure.account.auth.type.{end}": "SharedKey", f"fs.azure.account.key.{end}": pairs["AccountKey"]}
    if pairs.get("SharedAccessSignature"):
        return {f"fs.azure.account.auth.type.{end}": "SAS", f"fs.azure.sas.fixed.token.{end}": pairs["SharedAccessSignature"]}
    if provider == "service_principal":
        return {
            f"fs.azure.account.auth.type.{end}": "OAuth",
            f"fs.azure.account.oauth.provider.type.{end}": "org.apache.hadoop.fs.azurebfs.oauth2.ClientCredsTokenProvider",
            f"fs.azure.account.oauth2.client.id.{end}": secret.get("client_id", ""),
            f"fs.azure.account.oauth2.client.secret.{end}": secret.get("client_secret", ""),
            f"fs.azure.account.oauth2.client.endpoint.{end}": f"https://login.microsoftonline.com/{secret.get('tenant_id', '')}/oauth2/token",
        }
    if provider == "credential_chain":
        chain = [x.strip() for x in secret.get("chain", "").split(";") if x.strip()]
        if "cli" in chain:  # Hadoop has no provider for the command line's login: the cluster may bring a class of its own
            if not secret.get("token_provider"):
                raise InvalidInput("the chain 'cli' needs the secret's token_provider: a token provider class on the cluster's class path")
            return {f"fs.azure.account.auth.type.{end}": "Custom", f"fs.azure.account.oauth.provider.type.{end}": secret["token_provider"]}
        if "workload_identity" in chain:
            return {f"fs.azure.account.auth.type.{end}": "OAuth", f"fs.azure.account.oauth.provider.type.{end}": "org.apache.hadoop.fs.azurebfs.oauth2.WorkloadIdentityTokenProvider"}
        return {
            f"fs.azure.account.auth.type.{end}": "OAuth",
            f"fs.azure.account.oauth.provider.type.{end}": "org.apache.hadoop.fs.azurebfs.oauth2.MsiTokenProvider",
        }
    log.info("no credentials for %s: reading as anyone", end)
    return {f"fs.azure.account.auth.type.{end}": "SAS", f"fs.azure.sas.fixed.token.{end}": ""}


def configure(spark: SparkSession, path: str, secret: dict | None) -> str:
    """Put a secret's settings into the session's Hadoop configuration; returns the path to read."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in hadoop_options(path, secret).items():
        conf.set(k, v)
    return spark_path(path, secret)
