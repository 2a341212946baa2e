"""Window detectors, chosen by name."""

from .base import Detector, PythonDetector, Settings, create, register, registered
from .compressibility import CompressibilityDetector, FeatureCompressibilityDetector
from .interarrival import InterArrivalCvDetector
from .packet_count import PacketCountDetector
from .port_entropy import PortEntropyDetector

__all__ = [
    "CompressibilityDetector", "Detector", "FeatureCompressibilityDetector", "InterArrivalCvDetector",
    "PacketCountDetector", "PortEntropyDetector", "PythonDetector", "Settings", "create", "register", "registered",
]
