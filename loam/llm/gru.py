"""A gated recurrent layer in numpy: steps, their gradients, and Adam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """Inputs are symbols: a row of ``x`` is a symbol's part of the update gate, the reset gate and the candidate."""

    def __init__(self, symbols: int, size: int, rng: np.random.Generator):
        scale = 1 / np.sqrt(size)
        self.size = size
        self.x = rng.normal(0, scale, (symbols, 3 * size)).astype(np.float32)
        self.u = rng.normal(0, scale, (size, 3 * size)).astype(np.float32)
        self.b = np.zeros(3 * size, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b]

    def step(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = self.size
        a, g = self.x[ids], h @ self.u + self.b
        gates = sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
        new = np.tanh(a[:, 2 * n :] + gates[:, n:] * g[:, 2 * n :])
        return new + gates[:, :n] * (h - new)

    def stepper(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """``step`` for many steps, faster."""
        return _stepper([self])

    def step_kept(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """A step and what its gradient needs."""
        n = self.size
        a = self.x[ids]
        g = h @ self.u
        g += self.b
        gates = a[:, : 2 * n] + g[:, : 2 * n]
        gates *= np.float32(0.5)
        np.tanh(gates, out=gates)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        z, r, held = gates[:, :n], gates[:, n:], g[:, 2 * n :]
        new = r * held
        new += a[:, 2 * n :]
        np.tanh(new, out=new)
        out = h - new
        kept = (ids, h, z, r, new, held, out.copy())
        out *= z
        out += new
        return out, kept

    def back_rows(self, kept: tuple, dh: np.ndarray, grad_u: np.ndarray, grad_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradient of the state before a step and that of each symbol's row; adds the others."""
        _, h, z, r, new, held, apart = kept
        n = self.size
        rows = np.empty((len(h), 3 * n), np.float32)
        d_g = np.empty((len(h), 3 * n), np.float32)
        through = dh * z
        d_new = dh - through  # dh * (1 - z)
        through_z = through * apart
        d_g[:, :n] = through_z - through_z * z
        slope = new * new
        slope -= 1
        d_new *= slope
        np.negative(d_new, out=d_new)
        by_r = d_new * r
        d_g[:, 2 * n :] = by_r
        by_r *= held
        d_g[:, n : 2 * n] = by_r - by_r * r
        rows[:, : 2 * n] = d_g[:, : 2 * n]
        rows[:, 2 * n :] = d_new
        grad_u += h.T @ d_g
        grad_b += d_g.sum(0)
        through += d_g @ self.u.T
        return through, rows

    def back(self, kept: tuple, dh: np.ndarray, grads: list[np.ndarray]) -> np.ndarray:
        """Adds a step's gradients to ``grads`` and returns that of the state before."""
        before, rows = self.back_rows(kept, dh, grads[1], grads[2])
        np.add.at(grads[0], kept[0], rows)
        return before

    def window(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """The states (step, unit, stream) after each of the steps ``ids`` (step, stream) and what their gradients need; ``fresh``:
        where a state is 0 before the step.  Units come first, so that whatever is done to gates is done to long rows."""
        n, (steps, lanes) = self.size, ids.shape
        x = np.ascontiguousarray(self.x.take(ids.ravel(), 0).T).reshape(3 * n, steps, lanes)
        u, b = np.ascontiguousarray(self.u.T), self.b[:, None]
        stays = (~fresh).astype(np.float32)
        h = np.ascontiguousarray(h.T)
        out, kept = np.empty((steps, n, lanes), np.float32), []
        for t in range(steps):
            h = h * stays[t]
            g = u @ h
            g += b
            gates = g[: 2 * n] + x[: 2 * n, t]
            gates *= np.float32(0.5)
            np.tanh(gates, out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            z, r, held = gates[:n], gates[n:], g[2 * n :]
            new = r * held
            new += x[2 * n :, t]
            np.tanh(new, out=new)
            apart = h - new
            kept.append((h, z, r, new, held, apart))
            h = out[t]
            np.multiply(apart, z, out=h)
            h += new
        return out, kept

    def back_window(self, kept: list[tuple], fresh: np.ndarray, dh: np.ndarray, grad_u: np.ndarray, grad_b: np.ndarray) -> np.ndarray:
        """The gradients (part, step and stream) of the symbols' rows in a window, from those of its states; adds the others and
        uses up ``kept``."""
        n, (steps, lanes) = self.size, fresh.shape
        rows = np.empty((3 * n, steps, lanes), np.float32)
        stays = (~fresh).astype(np.float32)
        d_g, through = np.empty((3 * n, lanes), np.float32), np.zeros((n, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, new, held, apart = kept[t]
            through += dh[t]
            d_new = through.copy()
            through *= z
            d_new -= through  # times 1 - z
            d_z = through * apart
            np.multiply(d_z, z, out=apart)
            np.subtract(d_z, apart, out=d_g[:n])
            new *= new
            np.subtract(np.float32(1), new, out=new)
            d_new *= new
            by_r = d_g[2 * n :]
            np.multiply(d_new, r, out=by_r)
            held *= by_r
            r *= held
            np.subtract(held, r, out=d_g[n : 2 * n])
            rows[: 2 * n, t] = d_g[: 2 * n]
            rows[2 * n :, t] = d_new
            grad_u += h @ d_g.T
            grad_b += d_g.sum(1)
            through += self.u @ d_g
            through *= stays[t]
        return rows.reshape(3 * n, -1)


def both(one: Gru, other: Gru) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``step`` of two layers side by side: symbols (2, n), those of the second counted on from those of the first, and states
    (2, n, size)."""
    return _stepper([one, other])


def _stepper(layers: list[Gru]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Steps of layers side by side.  Halves and biases are put into the weights beforehand."""
    n = layers[0].size
    bias = np.zeros(3 * n, np.float32)
    x = np.concatenate([g.x + np.concatenate([g.b[: 2 * n], bias[2 * n :]]) for g in layers])
    x_gates, x_new = x[:, : 2 * n] * np.float32(0.5), np.ascontiguousarray(x[:, 2 * n :])
    u = np.stack([g.u for g in layers]) * np.float32(0.5)
    u_gates, u_new = np.ascontiguousarray(u[:, :, : 2 * n]), np.ascontiguousarray(u[:, :, 2 * n :])
    b_new = np.stack([g.b[2 * n :] for g in layers])[:, None, :] * np.float32(0.5)
    if len(layers) == 1:
        u_gates, u_new, b_new = u_gates[0], u_new[0], b_new[0]

    def step(ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        gates = np.matmul(h, u_gates)
        gates += x_gates.take(ids, 0)
        np.tanh(gates, out=gates)
        gates += 1  # twice the gates
        new = np.matmul(h, u_new)
        new += b_new
        new *= gates[..., n:]
        new += x_new.take(ids, 0)
        np.tanh(new, out=new)
        out = h - new
        out *= gates[..., :n]
        out *= np.float32(0.5)
        out += new
        return out

    return step


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray], clip: float = 5.0) -> None:
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        scale = min(1.0, clip / (norm + 1e-9))
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
