"""Providers of texts: a template that works offline, retries around any other, and a registry."""

from __future__ import annotations

import re
import hashlib
import time
from collections.abc import Callable

OPENERS = (
    "I have used this for a while now.", "We moved over last spring.", "My team depends on it daily.", "It took a week to settle in.",
    "Our trial turned into a long stay.",
)
GOOD = (
    "The setup was easy and the interface is clear.", "Support has been helpful and fast.",
    "It is reliable under load and simple to extend.", "The integration with our pipeline works well.",
    "Exports are efficient and the docs are solid.",
)
BAD = (
    "The sync is slow and the errors are confusing.", "Support was poor when deployment was broken.",
    "Several features are missing or limited.", "The configuration is complicated and buggy.", "Problems with exports keep coming back.",
)


class TemplateProvider:
    """Texts made from the prompts alone: the same prompts give the same text on every worker. For tests and dry runs."""

    def generate(self, system_prompt: str, user_prompt: str, temperature: float | None = None, max_tokens: int = 1024) -> dict:
        digest = hashlib.sha256(f"{system_prompt}\0{user_prompt}\0{temperature}".encode()).digest()
        stars = next((int(w[0]) for w in user_prompt.split() if w[1:] == "-star" and w[0].isdigit()), 3)
        pool = GOOD if stars >= 4 else BAD if stars <= 2 else tuple(x for pair in zip(GOOD, BAD) for x in pair)
        lines = [OPENERS[digest[0] % len(OPENERS)]]
        for i in range(1, 4 + digest[1] % 9):
            lines.append(pool[digest[i] % len(pool)])
            lines.append(f"Note {digest[i + 12]} on {hashlib.md5(digest[i:]).hexdigest()[:6]} stands.")
        text = " ".join(lines)
        used = len((system_prompt + user_prompt).split()), len(text.split())
        return {
            "text": text, "model": "template", "time": 0.0, "cost": 0.0,
            "tokens": {"input": used[0], "output": used[1], "total": sum(used)}, "success": True,
        }


class Retrying:
    """Any provider, tried again when it fails: after what the message asks to wait, or 1, 2, 4... seconds."""

    def __init__(self, inner, attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.attempts, self.sleep = inner, attempts, sleep

    def generate(self, system_prompt: str, user_prompt: str, temperature: float | None = None, max_tokens: int = 1024) -> dict:
        result: dict = {"text": None, "success": False, "error": "not called", "time": 0.0, "cost": 0.0}
        for i in range(self.attempts):
            try:
                result = self.inner.generate(system_prompt, user_prompt, temperature=temperature, max_tokens=max_tokens)
            except Exception as e:  # a provider's failure is a result
                result = {"text": None, "success": False, "error": str(e), "time": 0.0, "cost": 0.0}
            if result.get("success") and (result.get("text") or "").strip():
                return result
            if i + 1 < self.attempts:
                self.sleep(wait_seconds(str(result.get("error") or ""), i))
        return result | {"success": False, "error": result.get("error") or "the text is empty"}


#: How a service names the wait: a number, then its unit.
WAIT = re.compile(r"try again in ([\d,.]*\d)(ms|s\.)")


def wait_seconds(message: str, attempt: int) -> float:
    """The wait that a service's message names, and half a second; without one it doubles with each attempt."""
    named = WAIT.search(message)
    return float(named[1].replace(",", "")) * {"ms": 0.001, "s.": 1.0}[named[2]] + 0.5 if named else 2.0**attempt


REGISTRY: dict[str, Callable[[], object]] = {"offline": TemplateProvider}


def make(name: str):
    """A provider by its registered name."""
    if name not in REGISTRY:
        raise KeyError(f"no provider is registered as {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]()


class Throttled:
    """Any provider, within a quota of calls and tokens a minute. A quota for all is shared out among the tasks."""

    def __init__(
        self, inner, calls: int, tokens: int, tasks: int = 1, now: Callable[[], float] = time.monotonic,
        sleep: Callable[[float], None] = time.sleep,
    ):
        self.inner, self.calls, self.tokens, self.now, self.sleep = inner, max(1, calls // tasks), max(1, tokens // tasks), now, sleep
        self.past: list[tuple[float, int]] = []

    def generate(self, system_prompt: str, user_prompt: str, temperature: float | None = None, max_tokens: int = 1024) -> dict:
        while True:
            at = self.now()
            self.past = [p for p in self.past if at - p[0] < 60]
            if len(self.past) < self.calls and sum(n for _, n in self.past) < self.tokens:
                break
            self.sleep(max(0.0, 60 - (at - self.past[0][0])))
        result = self.inner.generate(system_prompt, user_prompt, temperature=temperature, max_tokens=max_tokens)
        self.past.append((self.now(), int((result.get("tokens") or {}).get("total") or 0)))
        return result


def post_json(url: str, body: dict, headers: dict[str, str], seconds: float = 60) -> dict:
    """The answer of a web service; an HTTP error's own message is raised."""
    import json
    import urllib.error
    import urllib.request

    call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(call, timeout=seconds) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        raise RuntimeError(e.read().decode("utf-8", "replace") or str(e)) from e


class ChatProvider:
    """A chat service of the common kind (messages in, choices out): give its address, model and key variable.

    The key is read where the provider is made, from the environment of the worker. price(model, in, out, reported)
    gives the cost; tokens that the service doesn't count are estimated as 1.3 a word.
    """

    def __init__(
        self, url: str, model: str, key_variable: str, price: Callable[[str, int, int, float | None], float] | None = None,
        headers: dict[str, str] | None = None, post: Callable[..., dict] = post_json,
    ):
        from glossmill.sources.io import api_key

        self.url, self.model, self.price, self.post = url, model, price, post
        self.headers = {"Authorization": f"Bearer {api_key(key_variable)}", **(headers or {})}

    def generate(self, system_prompt: str, user_prompt: str, temperature: float | None = None, max_tokens: int = 1024) -> dict:
        began = time.monotonic()
        try:
            body = {
                "model": self.model, "messages": [{"role": "system", "content": system_prompt}, {"role": "user", "content": user_prompt}],
                "max_tokens": max_tokens,
            }
            answer = self.post(self.url, body if temperature is None else body | {"temperature": temperature}, self.headers)
            text = (answer["choices"][0]["message"]["content"] or "").strip()
            if not text:
                raise RuntimeError("the text is empty")
            used = answer.get("usage") or {}
            i = int(used.get("prompt_tokens") or 1.3 * len((system_prompt + " " + user_prompt).split()))
            o = int(used.get("completion_tokens") or 1.3 * len(text.split()))
            cost = self.price(self.model, i, o, used.get("total_cost")) if self.price else 0.0
            return {
                "text": text, "model": self.model, "time": time.monotonic() - began, "cost": cost,
                "tokens": {"input": i, "output": o, "total": i + o}, "success": True,
            }
        except Exception as e:  # a failure is a result
            return {
                "text": None, "model": self.model, "time": time.monotonic() - began, "cost": 0.0, "tokens": {}, "success": False,
                "error": str(e),
            }


class JointPromptProvider:
    """A service that takes one prompt, not messages, and counts no tokens: both prompts go as one text, with fixed
    nucleus and top-k sampling; tokens are estimated as 1.3 a word."""

    #: Fixed values of the sampling.
    TOP_P, TOP_K = 0.95, 40

    def __init__(
        self, url: str, model: str, key_variable: str, price: Callable[[str, float, float, float | None], float] | None = None,
        post: Callable[..., dict] = post_json,
    ):
        from glossmill.sources.io import api_key

        self.url, self.model, self.price, self.post = url.replace("{model}", model), model, price, post
        self.headers = {"x-goog-api-key": api_key(key_variable)}

    def generate(self, system_prompt: str, user_prompt: str, temperature: float | None = None, max_tokens: int = 1024) -> dict:
        began = time.monotonic()
        try:
            whole = f"{system_prompt}\n\n{user_prompt}"
            sampling = {
                "topP": self.TOP_P, "topK": self.TOP_K, "maxOutputTokens": max_tokens
            } | ({} if temperature is None else {"temperature": temperature})
            answer = self.post(
                self.url, {"contents": [{"role": "user", "parts": [{"text": whole}]}], "generationConfig": sampling}, self.headers
            )
            text = "".join(p.get("text", "") for p in answer["candidates"][0]["content"]["parts"])
            i, o = 1.3 * len(whole.split()), 1.3 * len(text.split())
            cost = self.price(self.model, i, o, None) if self.price else 0.0
            return {
                "text": text, "model": self.model, "time": time.monotonic() - began, "cost": cost,
                "tokens": {"input": int(i), "output": int(o), "total": int(i + o)}, "success": True,
            }
        except Exception as e:  # a failure is a result
            return {
                "text": None, "model": self.model, "time": time.monotonic() - began, "cost": 0.0, "tokens": {}, "success": False,
                "error": str(e),
            }


class Cleaned:
    """Any provider, whose texts lose wrapping quotes and code fences; a text of which nothing is left is a failure."""

    def __init__(self, inner):
        self.inner = inner

    def generate(self, system_prompt: str, user_prompt: str, temperature: float | None = None, max_tokens: int = 1024) -> dict:
        r = self.inner.generate(system_prompt, user_prompt, temperature=temperature, max_tokens=max_tokens)
        if not r.get("success"):
            return r
        text = unwrapped(r.get("text") or "")
        return r | ({"text": text} if text else {"text": None, "success": False, "error": "the text is empty", "cost": 0.0})


#: A text that is quoted as a whole, and one that is a code block as a whole.
WRAPPINGS = (re.compile(r"""(["'])(.*)\1""", re.S), re.compile(r"```[^\n]*\n(.*)\n[^\n]*```", re.S))


def unwrapped(text: str) -> str:
    """What stands within quotes around the whole text, and within a code block around that."""
    for wrapping in WRAPPINGS:
        if whole := wrapping.fullmatch(text.strip()):
            text = whole[whole.lastindex]
    return text.strip()


def paid(service: str) -> Callable[[str, float, float, float | None], float]:
    """The cost of a call to a service, by the prices of metrics.cost."""
    from glossmill.operators import metrics as m

    def openai(model, i, o, reported):
        a, b = m.PER_THOUSAND.get(model, m.PER_THOUSAND_DEFAULT)
        return i / 1000 * a + o / 1000 * b

    def gemini(model, i, o, reported):
        a, b = m.PER_MILLION.get(model, m.PER_MILLION_DEFAULT)
        return i / 1e6 * a + o / 1e6 * b

    def router(model, i, o, reported):
        if reported is not None:
            return float(reported)
        return 0.0 if ":free" in model else (i * m.ROUTER_INPUT + o * m.ROUTER_OUTPUT) / 1000

    return {
        "openai": openai, "gemini": gemini, "groq": lambda model, i, o, reported: (i + o) * m.GROQ_PER_TOKEN, "openrouter": router
    }[service]


#: The address of a service, and the variable that holds its key.
SERVICES = {
    "openai": ("https://api.openai.com/v1/chat/completions", "OPENAI_API_KEY"),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "GEMINI_API_KEY"),
    "groq": ("https://api.groq.com/openai/v1/chat/completions", "GROQ_API_KEY"),
    "openrouter": ("https://openrouter.ai/api/v1/chat/completions", "OPENROUTER_API_KEY"),
}


def service(
    name: str, model: str, key_variable: str | None = None, post: Callable[..., dict] = post_json,
    sleep: Callable[[float], None] = time.sleep, quota: tuple[int, int] | None = None,
):
    """A service's provider: gemini takes one prompt; groq is tried three times, with what it asks to wait, and cleaned.
    quota (calls and tokens a minute) throttles it."""
    url, variable = SERVICES[name]
    kind = JointPromptProvider if name == "gemini" else ChatProvider
    p = kind(url, model, key_variable or variable, paid(name), post=post)
    if quota:
        p = Throttled(p, *quota, sleep=sleep)
    return Retrying(Cleaned(p), 3, sleep) if name == "groq" else p


def by_key(key: str, **options):
    """The provider of a model key (service/model, or the name of a registered one); an unknown key is an error."""
    name, _, model = key.partition("/")
    if name in SERVICES and model:
        return service(name, model, **options)
    if name == "local" and model:
        return LocalProvider(model)
    return make(key)


class LocalProvider:
    """A model on the worker, loaded when it is first asked and let go by close(); needs the transformers library."""

    def __init__(self, model: str, max_input: int = 2048):
        self.model, self.max_input, self.run = model, max_input, None

    def load(self) -> None:
        try:
            from transformers import pipeline
        except ImportError as e:
            raise ImportError("local models need the transformers library") from e
        self.run = pipeline("text-generation", model=self.model)

    def generate(self, system_prompt: str, user_prompt: str, temperature: float | None = None, max_tokens: int = 256) -> dict:
        began = time.monotonic()
        try:
            if self.run is None:
                self.load()
            chat = [{"role": "system", "content": system_prompt}, {"role": "user", "content": user_prompt}]
            made = self.run(
                chat, max_new_tokens=max_tokens, do_sample=True, temperature=temperature or 1.0, truncation=True, max_length=self.max_input
            )
            text = made[0]["generated_text"][-1]["content"].strip()
            return {
                "text": text, "model": self.model, "time": time.monotonic() - began, "cost": 0.0, "tokens": {}, "success": bool(text),
                "error": None if text else "the text is empty",
            }
        except Exception as e:  # a failure is a result
            return {"text": None, "model": self.model, "time": time.monotonic() - began, "cost": 0.0, "success": False, "error": str(e)}

    def close(self) -> None:
        self.run = None


def timed(
    provider, runs: int = 3, system_prompt: str = "You write short reviews.",
    user_prompt: str = "Write a 4-star review of 50 to 100 words.", max_tokens: int = 120,
) -> dict:
    """Calls in a row: how many went well, the mean and the least seconds, and the last text (or error)."""
    took, good, last = [], 0, ""
    for _ in range(max(1, runs)):
        began = time.monotonic()
        r = provider.generate(system_prompt, user_prompt, max_tokens=max_tokens)
        took.append(time.monotonic() - began)
        good += bool(r.get("success"))
        last = r.get("text") or str(r.get("error") or "")
    return {"runs": len(took), "succeeded": good, "mean_seconds": sum(took) / len(took), "least_seconds": min(took), "last": last}


def fetched(model: str, into: str) -> str:
    """The folder of a model's weights, loaded by the library that LocalProvider uses; needs its service."""
    try:
        from huggingface_hub import snapshot_download
    except ImportError as e:
        raise ImportError("fetching models needs the huggingface_hub library") from e
    return snapshot_download(model, local_dir=into)


class RuleJudge:
    """A judge that works offline: it answers a judge's prompt in JSON by the prompt's own text, the same everywhere."""

    def generate(self, system_prompt: str, user_prompt: str, temperature: float | None = None, max_tokens: int = 1024) -> dict:
        criterion = user_prompt.split("\n", 1)[0].removeprefix("Criterion: ").strip()
        digest = hashlib.sha256(user_prompt.encode()).digest()
        score = 4 + digest[0] % 6
        if digest[1] % 16 == 0:
            return {"text": None, "success": False, "error": "unavailable", "time": 0.0, "cost": 0.0}
        text = f'{{"{criterion}_score": {score}, "decision": "{"PASS" if score >= 6 else "FAIL"}", "feedback": "note {digest[2]}"}}'
        return {
            "text": f"```json\n{text}\n```" if digest[1] % 3 == 0 else text, "model": "rules", "time": 0.0, "cost": 0.0, "tokens": {},
            "success": True,
        }


class Draft:
    """Gives back the draft that a prompt holds: texts of a table stand for those of a service."""

    MARK = "Draft:\n"

    def generate(self, system_prompt: str, user_prompt: str, temperature: float | None = None, max_tokens: int = 1024) -> dict:
        text = user_prompt.partition(self.MARK)[2]
        return {"text": text, "model": "draft", "time": 0.0, "cost": 0.0, "tokens": {}, "success": bool(text)}


REGISTRY["rules"] = RuleJudge
