import pytest

from broadsheet.operators.pacing import DomainDelay, TokenBucket, with_retries


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def test_token_bucket():
    clock = Clock()
    bucket = TokenBucket(2 / 60, 2, clock, clock.sleep)
    assert [bucket.acquire() for _ in range(3)] == [0.0, 0.0, 30.0]
    clock.now += 1000
    assert [bucket.acquire() for _ in range(2)] == [0.0, 0.0]
    with pytest.raises(ValueError):
        TokenBucket(0)


def test_domain_delay():
    clock = Clock()
    delay = DomainDelay(1, 5, lambda a, b: b, clock, clock.sleep)
    assert [delay.wait("a"), delay.wait("b"), delay.wait("a")] == [0.0, 0.0, 5.0]


def test_retries():
    clock, calls = Clock(), []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise ConnectionError
        return "x"

    assert with_retries(call, 5, lambda e: isinstance(e, ConnectionError), clock.sleep) == "x"
    assert clock.slept == [1.0, 2.0, 4.0]
    with pytest.raises(ValueError):
        with_retries(lambda: (_ for _ in ()).throw(ValueError()), 5, lambda e: False, clock.sleep)
