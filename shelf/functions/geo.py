"""Approximate coordinates of postal areas."""

from __future__ import annotations

# Default coordinate of an unknown postal area.
DEFAULT_POINT = (28.6139, 77.2090)

# Two-digit postal prefix, latitude, longitude.
POSTAL_POINTS = [
    ("11", 28.6139, 77.2090), ("12", 28.4595, 77.0266), ("13", 30.7333, 76.7794), ("14", 30.7333, 76.7794), ("15", 32.7266, 74.8570),
    ("16", 31.1048, 77.1734), ("17", 31.1048, 77.1734), ("18", 34.0837, 74.7973), ("19", 34.0837, 74.7973), ("20", 26.8467, 80.9462),
    ("21", 25.4358, 81.8463), ("22", 26.4499, 80.3319), ("23", 27.1767, 78.0081), ("24", 28.9845, 77.7064), ("25", 28.6692, 77.4538),
    ("26", 26.8467, 80.9462), ("27", 26.8467, 80.9462), ("28", 26.4499, 80.3319), ("29", 26.9124, 75.7873), ("30", 26.9124, 75.7873),
    ("31", 28.0229, 73.3119), ("32", 26.2389, 73.0243), ("33", 24.5854, 73.7125), ("34", 25.1743, 75.8554), ("35", 25.1743, 75.8554),
    ("36", 23.2599, 77.4126), ("37", 21.1458, 79.0882), ("38", 23.0225, 72.5714), ("39", 21.1702, 72.8311), ("40", 19.0760, 72.8777),
    ("41", 18.5204, 73.8567), ("42", 19.8762, 75.3433), ("43", 20.9374, 77.7796), ("44", 21.1458, 79.0882), ("45", 22.7196, 75.8577),
    ("46", 23.2599, 77.4126), ("47", 23.1815, 79.9864), ("48", 23.1815, 79.9864), ("49", 21.2514, 81.6296), ("50", 17.3850, 78.4867),
    ("51", 17.3850, 78.4867), ("52", 15.8281, 78.0373), ("53", 17.6868, 83.2185), ("54", 16.5062, 80.6480), ("55", 15.4909, 78.4867),
    ("56", 12.9716, 77.5946), ("57", 15.3647, 75.1240), ("58", 15.3647, 75.1240), ("59", 15.8497, 74.4977), ("60", 13.0827, 80.2707),
    ("61", 10.7905, 78.7047), ("62", 9.9252, 78.1198), ("63", 11.0168, 76.9558), ("64", 11.0168, 76.9558), ("65", 8.7642, 77.6990),
    ("66", 11.8745, 75.3704), ("67", 11.2588, 75.7804), ("68", 9.9312, 76.2673), ("69", 8.5241, 76.9366), ("70", 22.5726, 88.3639),
    ("71", 22.5726, 88.3639), ("72", 22.5726, 88.3639), ("73", 22.5726, 88.3639), ("74", 22.5726, 88.3639), ("75", 20.2961, 85.8245),
    ("76", 20.2961, 85.8245), ("77", 26.1445, 91.7362), ("78", 26.1445, 91.7362), ("79", 23.9408, 91.9882), ("80", 25.6093, 85.1376),
    ("81", 25.6093, 85.1376), ("82", 23.3441, 85.3096), ("83", 23.3441, 85.3096), ("84", 26.1542, 86.0614), ("85", 25.2425, 86.9842),
]
