"""Spellings under which telemetry files name their columns."""

from __future__ import annotations

import re

# Canonical name and its spellings, in order of preference.
VARIANTS: dict[str, list[str]] = {
    "speed": ["Speed (km/h)", "Vehicle Speed Sensor [km/h]", "VEHICLE_SPEED", "VEHICLE_SPEED ()", "SPEED", "speed", "gps_speed", "Speed (GPS)(km/h)", "Speed (OBD)(km/h)", "Average trip speed(whilst moving only)(km/h)", "Average trip speed(whilst stopped or moving)(km/h)", "velocity", "car_speed"],
    "rpm": ["Engine RPM [RPM]", "ENGINE_RPM", "ENGINE_RPM ()", "ENGINE RPM(rpm)", "rpm", "Motor speed (rpm)", "engine_rpm", "motor_rpm", "revolutions_per_minute"],
    "acceleration": ["Acceleration (m/s²)", "Acceleration Sensor(Total)(g)", "accData", "acceleration", "accel", "longitudinal_acceleration", "acc_x", "acc_y", "acc_z"],
    "brake": ["Braking intensity (%)", "Braking intensity ()", "Regen braking level (%)", "Regen braking state", "brake_position", "brake_pedal", "braking_force"],
    "throttle": ["Throttle position (%)", "THROTTLE", "THROTTLE ()", "Absolute Throttle Position [%]", "Throttle Position(Manifold)(%)", "Absolute Throttle Position B(%)", "tPos", "THROTTLE_POS", "throttle_position", "accelerator_position", "gas_pedal"],
    "engine_load": ["ENGINE_LOAD", "ENGINE_LOAD ()", "Engine Load(Absolute)(%)", "Engine Load(%)", "eLoad", "calculated_engine_load", "engine_load_percent"],
    "coolant_temp": ["COOLANT_TEMPERATURE", "COOLANT_TEMPERATURE ()", "Engine Coolant Temperature [°C]", "ENGINE_COOLANT_TEMP", "Engine Coolant Temperature(°C)", "cTemp", "coolant_temperature", "engine_temp"],
    "battery": ["Battery SoC (%)", "Battery current (A)", "battery", "battery_voltage", "soc", "state_of_charge"],
    "fuel_level": ["FUEL_LEVEL", "FUEL_LEVEL ()", "FUEL_TANK", "Fuel Remaining (Calculated from vehicle profile)(%)", "fuel_tank_level", "fuel_percentage"],
    "trip_distance": ["Distance traveled (km)", "Trip distance (km)", "Trip Distance(km)", "Trip Distance", "distance", "odometer", "total_distance"],
    "trip_time": ["Trip time (min)", "Trip Time(Since journey start)(s)", "TIME", "duration", "elapsed_time"],
    "latitude": ["LATITUDE", "LATITUDE ()", "GPS Latitude(°)", "Latitude", "lat", "gps_lat"],
    "longitude": ["LONGITUDE", "LONGITUDE ()", "GPS Longitude(°)", "Longitude", "lon", "lng", "gps_lon"],
    "driver_rating": ["Driver Behavior rating", "driving_score", "safety_score", "performance_rating"],
    "user_id": ["User ID", "user_id", "driver_id", "Driver ID", "USER_ID", "DRIVER_ID", "UserId", "DriverId", "User", "Driver", "user", "driver"],
    "trip_id": ["Trip ID", "trip_id", "TRIP_ID", "TripId", "Trip", "trip", "journey_id"],
    "timestamp": ["Timestamp", "timestamp", "TIMESTAMP", "Time", "time", "TIME", "DateTime", "datetime", "DATETIME", "Date Time", "date_time", "recorded_at"],
    "steering_angle": ["Steering Angle", "steering_angle", "wheel_angle", "steering_position"],
    "angular_velocity": ["Angular Velocity", "angular_velocity", "yaw_rate", "rotation_rate"],
    "gear_position": ["Gear Position", "gear_position", "gear", "transmission_gear"],
    "tire_pressure": ["Tire Pressure", "tire_pressure", "wheel_pressure", "tyre_pressure"],
    "brake_pressure": ["Brake Pressure", "brake_pressure", "braking_pressure", "brake_force"],
    "vehicle_number": [
        "Vehicle Number", "vehicle_number", "VehicleNumber", "VEHICLE_NUMBER", "License Plate", "license_plate", "LicensePlate", "LICENSE_PLATE", "Registration Number", "registration_number", "RegNumber", "reg_number",
        "Plate Number", "plate_number", "PlateNumber", "PLATE_NUMBER", "Car Number", "car_number", "CarNumber", "CAR_NUMBER",
    ],
}


def plain(name: str) -> str:
    return re.sub(r"[^0-9a-z]", "", name.lower())


def mapping(header: list[str]) -> dict[str, str]:
    """canonical name: column of the header. Of several spellings the preferred one wins; a column that fits two names goes to the later."""
    by_plain: dict[str, str] = {}
    for column in header:
        by_plain.setdefault(plain(column), column)
    chosen: dict[str, str] = {}
    for canonical, spellings in VARIANTS.items():
        column = next((by_plain[plain(s)] for s in spellings if plain(s) in by_plain), None)
        if column is not None:
            chosen = {k: c for k, c in chosen.items() if c != column} | {canonical: column}
    return chosen
