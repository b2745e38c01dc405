"""Requests of a partition in flight: few at a time and fewer to one host, each under one deadline; answers leave by bytes."""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator

#: Requests in flight in a partition, those of them to one host, requests that wait, and bytes of answers that are held.
IN_FLIGHT, PER_HOST, WAITING, HELD_BYTES, HELD_ROWS = 5, 2, 500, 32_000_000, 500


class LookupTimeout(OSError):
    """A name was not resolved in time."""


def within(call: Callable, seconds: float):
    """call() if it ends in time, else LookupTimeout; a call that hangs is left behind, not waited for."""
    done: queue.SimpleQueue = queue.SimpleQueue()

    def run():
        try:
            done.put((call(), None))
        except BaseException as e:  # handed to the caller
            done.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        found, error = done.get(timeout=max(0.0, seconds))
    except queue.Empty:
        raise LookupTimeout("DNS lookup timed out") from None
    if error is not None:
        raise error
    return found


class Names:
    """A resolver that asks once for a name and keeps the answer, a failure too, for a while."""

    def __init__(self, lookup: Callable[[str, int], list[str]], seconds: float, keep: float = 60.0, most: int = 10_000):
        self.lookup, self.seconds, self.keep, self.most = lookup, seconds, keep, most
        self.known: dict[tuple[str, int], tuple[float, list[str] | None, Exception | None]] = {}
        self.guard, self.asked = threading.Lock(), {}

    def __call__(self, host: str, port: int, seconds: float | None = None) -> list[str]:
        key, until = (host, port), time.monotonic() + min(self.seconds, seconds if seconds is not None else self.seconds)
        with self.guard:
            lock = self.asked.setdefault(key, threading.Lock())
        if not lock.acquire(timeout=max(0.0, until - time.monotonic())):
            raise LookupTimeout("DNS lookup timed out")
        try:
            held = self.known.get(key)
            if held is None or held[0] < time.monotonic():
                try:
                    held = time.monotonic() + self.keep, within(lambda: self.lookup(host, port), until - time.monotonic()), None
                except (OSError, UnicodeError) as e:
                    held = time.monotonic() + self.keep, None, e
                with self.guard:
                    if len(self.known) >= self.most:
                        self.known.clear()
                    self.known[key] = held
        finally:
            lock.release()
            with self.guard:
                self.asked.pop(key, None)
        if held[2] is not None:
            raise held[2]
        return held[1]


def flown(requests: Iterable, one: Callable, host_of: Callable = lambda _: None, size_of: Callable = lambda _: 0, in_flight: int = IN_FLIGHT, per_host: int = PER_HOST) -> Iterator[list]:
    """Lists of one(request) of all requests, in the order in which they end. A request waits while its host has enough; no
    more requests are read than wait, and a list leaves when it holds enough bytes or rows."""
    source, ended = iter(requests), False
    waiting: dict[object, deque] = {}
    ready: deque = deque()  # hosts with waiting requests, in turn
    busy: dict[object, int] = {}
    done: queue.SimpleQueue = queue.SimpleQueue()
    work: queue.SimpleQueue = queue.SimpleQueue()
    n_waiting = n_busy = size = 0
    out: list = []

    def run():
        while (job := work.get()) is not None:
            host, request = job
            try:
                done.put((host, one(request), None))
            except BaseException as e:  # handed to the caller
                done.put((host, None, e))

    threads = [threading.Thread(target=run, daemon=True) for _ in range(in_flight)]
    for t in threads:
        t.start()
    try:
        while True:
            while not ended and n_waiting < WAITING:
                try:
                    request = next(source)
                except StopIteration:
                    ended = True
                    break
                host = host_of(request)
                if host not in waiting:
                    waiting[host] = deque()
                    ready.append(host)
                waiting[host].append(request)
                n_waiting += 1
            for _ in range(len(ready)):
                if n_busy >= in_flight:
                    break
                host = ready.popleft()
                if host is None or busy.get(host, 0) < per_host:
                    work.put((host, waiting[host].popleft()))
                    n_waiting, n_busy = n_waiting - 1, n_busy + 1
                    busy[host] = busy.get(host, 0) + 1
                if waiting[host]:
                    ready.append(host)
                else:
                    del waiting[host]
            if not n_busy:
                if ended and not n_waiting:
                    break
                continue
            host, answer, error = done.get()
            n_busy -= 1
            busy[host] -= 1
            if not busy[host]:
                del busy[host]
            if error is not None:
                raise error
            out.append(answer)
            size += size_of(answer)
            if size >= HELD_BYTES or len(out) >= HELD_ROWS:
                yield out
                out, size = [], 0
        if out:
            yield out
    finally:
        for _ in threads:
            work.put(None)
