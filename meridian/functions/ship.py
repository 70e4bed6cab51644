"""Ship physics as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ship:
    """mcr_w: full motor power in watts; drag: k of the power law; polar_c, polar_power: response to the wind;
    fuel: coefficients of the burn rate in kg/s at a load."""

    # The default ship.
    mcr_w: float = 1_000_000.0
    drag: float = 4_000.0
    polar_c: float = 1.5
    polar_power: float = 1.0
    fuel: tuple[float, float, float] = (0.0875, -0.0555, 0.0347)

    def checked(self) -> "Ship":
        """Itself, or ValueError naming the first field that is wrong."""
        numbers = {"mcr_w": self.mcr_w, "drag": self.drag, "polar_c": self.polar_c, "polar_power": self.polar_power, **{f"fuel[{k}]": v for k, v in enumerate(self.fuel)}}
        for name, v in numbers.items():
            if not math.isfinite(v):
                raise ValueError(f"{name}: {v} must be finite")
        if self.mcr_w <= 0:
            raise ValueError(f"mcr_w: {self.mcr_w} must be greater than 0")
        return self

    def wind_speed(self, bearing: Column, u: Column, v: Column) -> Column:
        """Speed from wind alone, greatest across the wind and none in a calm."""
        wind = F.hypot(u, v)
        across = F.abs(F.sin(bearing) * v - F.cos(bearing) * u) / F.when(wind == 0, F.lit(1.0)).otherwise(wind)
        return F.when(wind == 0, F.lit(0.0)).otherwise(self.polar_c * (1 + F.pow(across, F.lit(self.polar_power))) / 2 * wind)

    def motor_speed(self, wind_speed: Column, load: Column) -> Column:
        """Speed with the motor at a load of 0 to 1."""
        return F.cbrt(wind_speed * wind_speed * wind_speed + load * self.mcr_w / (0.5 * self.drag))

    def fuel_rate(self, load: Column) -> Column:
        a, b, c = self.fuel
        return F.when(load <= 0, F.lit(0.0)).otherwise(load * (a + b * load + c * load * load))

    def fuel_used(self, load: Column, seconds: Column) -> Column:
        if self.mcr_w <= 0:
            return F.lit(0.0)
        return F.when((seconds <= 0) | (load <= 0), F.lit(0.0)).otherwise(self.fuel_rate(load) * seconds)


def speed_kmh(metres: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, metres / F.when(seconds > 0, seconds).otherwise(F.lit(1.0)) * 3.6).otherwise(F.lit(0.0))


def fitness(seconds: Column, fuel: Column, land_m: Column, w_time: float, w_fuel: float, w_land: float) -> Column:
    """Minus the weighted cost; land does not count where its weight is 0, even if infinite."""
    cost = seconds * w_time + fuel * w_fuel
    return -(cost + land_m * w_land) if w_land else -cost


def cosine_decay(step: Column, steps: int, start: float, end: float) -> Column:
    """From start at step 1 to end at the last step along half a cosine."""
    t = F.least(F.greatest((step - 1) / float(max(steps - 1, 1)), F.lit(0.0)), F.lit(1.0))
    return end + (start - end) * 0.5 * (1 + F.cos(t * 3.141592653589793))


def cauchy(u: Column) -> Column:
    """A standard Cauchy number from a uniform one."""
    return F.tan((F.least(F.greatest(u, F.lit(1e-10)), F.lit(1 - 1e-10)) - 0.5) * 3.141592653589793)
