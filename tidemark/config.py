"""Configuration from a YAML file: defaults, checks, and secrets from files or the environment."""

from __future__ import annotations

import os
import re
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_args, get_origin, get_type_hints
from urllib.parse import urlsplit

from .alerts.datasources import TIMEOUT_MS
from .alerts.notify import QUEUE_SIZE, RETRIES
from .lang.parser import duration_ms
from .sources.push import MAX_BODY

DEFAULT_LISTEN = "127.0.0.1:9090"
SEVERITIES = ("critical", "error", "warning", "info", "debug")
_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(:-([^}]*))?\}")


class ConfigError(ValueError):
    pass


class Duration(float):
    """Seconds, written like 15s, 5m or 1h30m."""


@dataclass
class Authorization:
    type: str = "Bearer"
    credentials: str = ""
    credentials_file: str = ""


@dataclass
class BasicAuth:
    username: str = ""
    username_file: str = ""
    password: str = ""
    password_file: str = ""


@dataclass
class Tls:
    ca_file: str = ""
    cert_file: str = ""
    key_file: str = ""
    server_name: str = ""
    insecure_skip_verify: bool = False


@dataclass
class Static:
    targets: list[str] = field(default_factory=list)


@dataclass
class Scrape:
    job_name: str = ""
    scheme: str = ""
    scrape_interval: Duration = Duration(0)
    scrape_timeout: Duration = Duration(0)
    static_configs: list[Static] = field(default_factory=list)
    authorization: Authorization | None = None
    basic_auth: BasicAuth | None = None
    tls_config: Tls | None = None

    def targets(self) -> list[str]:
        return [t for s in self.static_configs for t in s.targets]


@dataclass
class Global:
    scrape_interval: Duration = Duration(15)
    scrape_timeout: Duration = Duration(10)


@dataclass
class Storage:
    path: str = ""
    retention: Duration = Duration(6 * 3600)


@dataclass
class Web:
    listen: str = DEFAULT_LISTEN


@dataclass
class Push:
    enabled: bool = True
    sample_limit: int = 0
    max_body_bytes: int = MAX_BODY
    auth_token: str = ""


@dataclass
class Notify:
    enabled: bool = False
    url: str = ""
    token: str = ""
    source: str = "tidemark"
    min_severity: str = ""
    timeout: Duration = Duration(5)
    queue_size: int = QUEUE_SIZE
    max_retries: int = RETRIES


@dataclass
class Remote:
    name: str = ""
    type: str = "prometheus"
    url: str = ""
    timeout: Duration = Duration(TIMEOUT_MS / 1000)
    authorization: Authorization | None = None
    basic_auth: BasicAuth | None = None
    headers: dict[str, str] = field(default_factory=dict)
    enabled: bool = True


@dataclass
class Alerting:
    enabled: bool = True
    storage_path: str = ""
    default_datasource: str = ""
    datasources: list[Remote] = field(default_factory=list)
    notify: Notify = field(default_factory=Notify)


@dataclass
class Config:
    global_: Global = field(default_factory=Global)
    storage: Storage = field(default_factory=Storage)
    web: Web = field(default_factory=Web)
    scrape_configs: list[Scrape] = field(default_factory=list)
    push: Push = field(default_factory=Push)
    alerting: Alerting = field(default_factory=Alerting)


def expanded(text: str) -> str:
    """``text`` with ${NAME} and ${NAME:-default}; a variable that is unset or empty needs a default."""

    def value(m: re.Match) -> str:
        found = os.environ.get(m[1], "")
        if found or m[2] is not None:
            return found or m[3]
        raise ConfigError(f"environment variable {m[1]!r} is not set or empty")

    return _VARIABLE.sub(value, text)


def _built(kind: Any, said: Any, where: str) -> Any:
    """A value of type ``kind`` from what YAML gave; null and absent mean the default."""
    if get_origin(kind) is list:
        if not isinstance(said, list):
            raise ConfigError(f"{where} must be a list")
        return [_built(get_args(kind)[0], x, f"{where}[{i}]") for i, x in enumerate(said)]
    if get_origin(kind) is dict:
        if not isinstance(said, dict):
            raise ConfigError(f"{where} must be a mapping")
        return {str(k): str(v) for k, v in said.items()}
    if type(None) in get_args(kind):
        return _built(get_args(kind)[0], said, where)
    if is_dataclass(kind):
        if not isinstance(said, dict):
            raise ConfigError(f"{where or 'the file'} must be a mapping")
        hints, out = get_type_hints(kind), {}
        names = {f.name.rstrip("_"): f.name for f in fields(kind)}
        for name, value in said.items():
            if name in names and value is not None:
                out[names[name]] = _built(hints[names[name]], value, f"{where}.{name}".strip("."))
        return kind(**out)
    if kind is Duration:
        try:
            return Duration(duration_ms(str(said)) / 1000)
        except ValueError as error:
            raise ConfigError(f"{where}: {error}") from None
    if kind is bool and not isinstance(said, bool) or kind is int and (isinstance(said, bool) or not isinstance(said, int)):
        raise ConfigError(f"{where} must be a {kind.__name__}")
    if isinstance(said, (dict, list)):
        raise ConfigError(f"{where} must be a {kind.__name__}")
    return kind(said)


def _filled(config: Config) -> None:
    """Zero and empty mean the default, as if they were not there; jobs take over what is global."""
    for part in (config.global_, config.storage, config.web, config.push, config.alerting.notify, *config.alerting.datasources):
        for f in fields(part):
            if f.default is not MISSING and f.default and not isinstance(f.default, bool) and not getattr(part, f.name) and f.name != "max_retries":
                setattr(part, f.name, f.default)
    if not config.scrape_configs:
        config.scrape_configs = [Scrape("tidemark", static_configs=[Static([config.web.listen])])]
    for job in config.scrape_configs:
        job.scrape_interval = job.scrape_interval or config.global_.scrape_interval
        job.scrape_timeout = job.scrape_timeout or config.global_.scrape_timeout


def _check_auth(part: Scrape | Remote, name: str) -> None:
    a, b = part.authorization, part.basic_auth
    if a and b:
        raise ConfigError(f"{name}: authorization and basic_auth exclude each other")
    for given, holder, fields_ in ((a, "authorization", ("credentials",)), (b, "basic_auth", ("username", "password"))):
        for f in fields_ if given else ():
            if getattr(given, f) and getattr(given, f"{f}_file"):
                raise ConfigError(f"{name}: {holder} {f} and {f}_file exclude each other")


def _unique(names: list[str], what: str) -> None:
    for i, name in enumerate(names):
        if not name:
            raise ConfigError(f"{what} needs a name")
        if name in names[:i]:
            raise ConfigError(f"{what} {name!r} is there twice")


def _check(config: Config) -> None:
    _unique([j.job_name for j in config.scrape_configs], "a scrape job")
    for job in config.scrape_configs:
        name = f"scrape job {job.job_name!r}"
        if not job.targets():
            raise ConfigError(f"{name} needs a target")
        if job.scheme not in ("", "http", "https"):
            raise ConfigError(f"{name}: the scheme must be http or https")
        _check_auth(job, name)
        if job.tls_config and bool(job.tls_config.cert_file) != bool(job.tls_config.key_file):
            raise ConfigError(f"{name}: cert_file and key_file need each other")
    alerting = config.alerting
    _unique([d.name for d in alerting.datasources], "a datasource")
    for source in alerting.datasources:
        if not source.url:
            raise ConfigError(f"datasource {source.name!r} needs a url")
        _check_auth(source, f"datasource {source.name!r}")
    if alerting.default_datasource and alerting.datasources and alerting.default_datasource not in [d.name for d in alerting.datasources]:
        raise ConfigError(f"there is no datasource {alerting.default_datasource!r}")
    notify = alerting.notify
    if notify.enabled:
        try:
            url = urlsplit(notify.url)
        except ValueError:
            raise ConfigError("notify: the url is malformed") from None
        if url.scheme not in ("http", "https") or not url.hostname:
            raise ConfigError("notify needs an http or https url with a host")
        if "@" in url.netloc:
            raise ConfigError("notify: the url must not hold credentials; use token")
        if not notify.token:
            raise ConfigError("notify needs a token")
        if notify.min_severity and notify.min_severity not in SEVERITIES:
            raise ConfigError(f"notify: min_severity must be one of {', '.join(SEVERITIES)}")


def _secret(part: Authorization | BasicAuth, name: str) -> None:
    """What is given inline, or the trimmed contents of the file that is named."""
    inline, file = getattr(part, name), getattr(part, f"{name}_file")
    if inline:
        setattr(part, name, expanded(inline))
    elif file:
        try:
            setattr(part, name, Path(expanded(file)).read_text().strip())
        except OSError as error:
            raise ConfigError(f"{name}_file: {error}") from None


def _resolve(config: Config) -> None:
    for part in (*config.scrape_configs, *config.alerting.datasources):
        if part.authorization:
            _secret(part.authorization, "credentials")
        if part.basic_auth:
            _secret(part.basic_auth, "username")
            _secret(part.basic_auth, "password")
    for job in config.scrape_configs:
        for name in ("ca_file", "cert_file", "key_file", "server_name") if job.tls_config else ():
            setattr(job.tls_config, name, expanded(getattr(job.tls_config, name)))
    if config.alerting.notify.enabled:
        config.alerting.notify.token = expanded(config.alerting.notify.token)


def parsed(text: str) -> Config:
    """The configuration that a YAML document describes; raises ConfigError."""
    try:
        import yaml
    except ImportError:
        raise ConfigError("reading YAML needs the yaml package") from None
    try:
        said = yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise ConfigError(f"malformed YAML: {error}") from None
    config = _built(Config, said if said is not None else {}, "")
    _filled(config)
    _check(config)
    _resolve(config)
    return config


def load(path: str) -> Config:
    try:
        return parsed(Path(path).read_text())
    except OSError as error:
        raise ConfigError(str(error)) from None
