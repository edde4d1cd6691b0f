"""Functions of types 0 (sampled), 2, 3 and 4."""

from __future__ import annotations

import math

from quire.pdf.syntax import EOF, Keyword, Lexer, PdfError, Stream


def _clip(values, ranges):
    return [min(max(v, lo), hi) for v, lo, hi in zip(values, ranges[::2], ranges[1::2])] if ranges else list(values)


class Function:
    """A function object; call it with a list of inputs."""

    def __init__(self, doc, x):
        x = doc.resolve(x)
        d = x.dict if isinstance(x, Stream) else x
        if not isinstance(d, dict):
            raise PdfError("not a function")
        numbers = lambda key, default=None: [float(doc.resolve(v)) for v in doc.get(d, key, list) or default or []]
        self.kind, self.domain, self.range = doc.get(d, "FunctionType", int), numbers("Domain", [0, 1]), numbers("Range")
        if self.kind == 2:
            self.c0, self.c1, self.n = numbers("C0", [0]), numbers("C1", [1]), float(doc.get(d, "N", (int, float)) or 0)
        elif self.kind == 3:
            self.parts = [Function(doc, f) for f in doc.get(d, "Functions", list) or []]
            self.bounds, self.encode = numbers("Bounds"), numbers("Encode")
        elif self.kind == 4 and isinstance(x, Stream):
            self.program = parse_program(doc.decoded(x))
        elif self.kind == 0 and isinstance(x, Stream) and self.range:
            self._read_samples(doc.decoded(x), [int(v) for v in numbers("Size")], doc.get(d, "BitsPerSample", int) or 8, numbers("Encode"), numbers("Decode"))
        else:
            raise PdfError(f"function type {self.kind}")

    def _read_samples(self, data: bytes, size: list[int], bits: int, encode: list[float], decode: list[float]) -> None:
        n, total = len(self.range) // 2, math.prod(size)
        if len(size) != len(self.domain) // 2 or min(size, default=0) < 1 or bits not in (1, 2, 4, 8, 12, 16, 24, 32) or total * n * bits > 8 * len(data):
            raise PdfError("bad sampled function")
        whole, used = int.from_bytes(data), 8 * len(data)
        mask = (1 << bits) - 1
        decode = decode or self.range
        flat = [(whole >> (used - bits * (k + 1))) & mask for k in range(total * n)]
        self.samples = [[decode[2 * j] + flat[k * n + j] * (decode[2 * j + 1] - decode[2 * j]) / mask for j in range(n)] for k in range(total)]
        self.size, self.encode = size, encode or [v for s in size for v in (0, s - 1)]

    def _sampled(self, inputs: list[float]) -> list[float]:
        """Between the samples round a place, in proportion; the first input's samples lie next to each other."""
        corners, step = [(0, 1.0)], 1
        for k, (x, size) in enumerate(zip(inputs, self.size)):
            (lo, hi), (a, b) = self.domain[2 * k : 2 * k + 2], self.encode[2 * k : 2 * k + 2]
            e = min(max(a + (x - lo) * (b - a) / (hi - lo) if hi != lo else a, 0), size - 1)
            low = min(int(e), max(size - 2, 0))
            part = e - low
            corners = [(at + j * step, w * v) for at, w in corners for j, v in ((low, 1 - part), (min(low + 1, size - 1), part)) if v]
            step *= size
        return [sum(w * self.samples[at][j] for at, w in corners) for j in range(len(self.range) // 2)]

    def __call__(self, inputs: list[float]) -> list[float]:
        inputs = _clip(inputs, self.domain)
        if self.kind == 0:
            out = self._sampled(inputs)
        elif self.kind == 2:
            out = [a + inputs[0] ** self.n * (b - a) for a, b in zip(self.c0, self.c1)]
        elif self.kind == 3:
            x = inputs[0]
            k = sum(x >= b for b in self.bounds)
            k = min(k, len(self.parts) - 1)
            edges = [self.domain[0], *self.bounds, self.domain[1]]
            lo, hi, a, b = edges[k], edges[k + 1], *self.encode[2 * k : 2 * k + 2]
            out = self.parts[k]([a if hi == lo else a + (x - lo) * (b - a) / (hi - lo)])
        else:
            stack = list(inputs)
            execute(self.program, stack)
            out = stack[-len(self.range) // 2 :] if self.range else stack
        return _clip(out, self.range)


def parse_program(data: bytes) -> list:
    """A calculator program as nested lists of numbers and names."""
    lex = Lexer(data)

    def block():
        out = []
        while True:
            t = lex.token()
            if t is EOF:
                raise PdfError("a program does not end")
            if t == "}" and isinstance(t, Keyword):
                return out
            out.append(block() if t == "{" and isinstance(t, Keyword) else str(t) if isinstance(t, Keyword) else t)

    if lex.token() != "{":
        raise PdfError("a program starts with {")
    return block()


def _whole(x):
    return isinstance(x, int) and not isinstance(x, bool)


def _div(a, b):
    return a / b if b else 0.0


_UNARY = {
    "neg": lambda a: -a, "abs": abs, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc,
    "sqrt": lambda a: math.sqrt(max(a, 0)), "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)),
    "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0, "cvi": int, "cvr": float,
    "not": lambda a: (not a) if isinstance(a, bool) else ~int(a),
}
_BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": _div, "idiv": lambda a, b: int(_div(int(a), int(b))),
    "mod": lambda a, b: int(math.fmod(int(a), int(b))) if int(b) else 0, "exp": lambda a, b: float(a) ** b, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360,
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b, "bitshift": lambda a, b: int(a) << b if b >= 0 else int(a) >> -b,
}


def execute(program: list, stack: list) -> None:
    """Run a calculator program on a stack."""
    k = 0
    while k < len(program):
        op = program[k]
        k += 1
        if isinstance(op, list):
            other = program[k] if k < len(program) and isinstance(program[k], list) else None
            if other is not None and k + 1 < len(program) and program[k + 1] == "ifelse":
                execute(op if stack.pop() else other, stack)
                k += 2
            elif k < len(program) and program[k] == "if":
                if stack.pop():
                    execute(op, stack)
                k += 1
            else:
                raise PdfError("a procedure without if")
        elif not isinstance(op, str):
            stack.append(op)
        elif op in _UNARY:
            stack.append(_UNARY[op](stack.pop()))
        elif op in _BINARY:
            b, a = stack.pop(), stack.pop()
            stack.append(_BINARY[op](a, b))
        elif op in ("true", "false"):
            stack.append(op == "true")
        elif op == "pop":
            stack.pop()
        elif op == "dup":
            stack.append(stack[-1])
        elif op == "exch":
            stack[-2:] = stack[:-3:-1]
        elif op == "copy":
            n = int(stack.pop())
            stack += stack[-n:] if n > 0 else []
        elif op == "index":
            stack.append(stack[-1 - int(stack.pop())])
        elif op == "roll":
            j, n = int(stack.pop()), int(stack.pop())
            if n > 0:
                own = stack[-n:]
                j %= n
                stack[-n:] = own[-j:] + own[:-j] if j else own
        else:
            raise PdfError(f"unknown operator {op}")
