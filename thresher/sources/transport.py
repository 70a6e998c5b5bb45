"""HTTP clients of the sources: trust, pinned addresses, no automatic redirects."""

from __future__ import annotations

import http.client
import os
import socket
import ssl
import urllib.request
import warnings
from dataclasses import dataclass

#: Fixed value.
USER_AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36"


def truth(value: str | None) -> bool:
    return (value or "").lower() in ("1", "true")


def transient(status: int) -> bool:
    return status == 429 or 500 <= status <= 599


@dataclass(frozen=True)
class Tls:
    """Roots of the system, of SSL_CERT_FILE and of ``ca_certs``; ``insecure`` verifies nothing."""

    ca_certs: tuple[str, ...] = ()
    insecure: bool = False

    @classmethod
    def of(cls, options: dict) -> Tls:
        """From source options: ca_certs (paths, comma-separated), insecure."""
        return cls(tuple(x.strip() for x in options.get("ca_certs", "").split(",") if x.strip()), truth(options.get("insecure")))

    def context(self) -> ssl.SSLContext:
        """An unreadable SSL_CERT_FILE warns; an unreadable bundle of ``ca_certs`` raises."""
        if self.insecure:
            warnings.warn("certificate verification is off", stacklevel=2)
            return ssl._create_unverified_context()
        context = ssl.create_default_context()
        if path := os.environ.get("SSL_CERT_FILE"):
            try:
                context.load_verify_locations(path)
            except OSError as e:
                warnings.warn(f"SSL_CERT_FILE ({path}) is unreadable: {e}", stacklevel=2)
        for path in self.ca_certs:
            try:
                context.load_verify_locations(path)
            except OSError as e:
                raise OSError(f"reading CA bundle {path}: {e}") from e
        return context


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_, **__):
        return None


class _Hop(urllib.request.HTTPRedirectHandler):
    """At most ``hops`` redirects."""

    def __init__(self, hops: int):
        self.max_redirections, self.max_repeats = hops, hops


def _pinned(kind: type, addresses: list[str], **more):
    """A connection maker that goes to ``addresses`` in turn and keeps the name for Host and TLS."""

    def connect(at, *args):
        last: OSError | None = None
        for a in addresses:
            try:
                return socket.create_connection((a, at[1]), *args)
            except OSError as e:
                last = e
        raise last or OSError("no address")

    def make(host, **kw):
        c = kind(host, **kw, **more)
        if addresses and c._tunnel_host is None:
            c._create_connection = connect
        return c

    return make


class _Http(urllib.request.HTTPHandler):
    def __init__(self, addresses: list[str]):
        super().__init__()
        self.addresses = addresses

    def http_open(self, req):
        # Through a proxy the request's host is the proxy's, which is not what was looked up.
        return self.do_open(_pinned(http.client.HTTPConnection, [] if req.has_proxy() else self.addresses), req)


class _Https(urllib.request.HTTPSHandler):
    def __init__(self, addresses: list[str], context: ssl.SSLContext):
        super().__init__(context=context)
        self.addresses, self.trust = addresses, context

    def https_open(self, req):
        return self.do_open(_pinned(http.client.HTTPSConnection, [] if req._tunnel_host else self.addresses, context=self.trust), req)


def opener(tls: Tls = Tls(), addresses: list[str] | None = None, hops: int = 0) -> urllib.request.OpenerDirector:
    """A client that connects to ``addresses`` (if given) and follows ``hops`` redirects by itself."""
    found = addresses or []
    return urllib.request.build_opener(_Hop(hops) if hops else _Stay, _Http(found), _Https(found, tls.context()))
