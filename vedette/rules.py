"""Word lists, thresholds and lookup tables the results depend on.

Callers may pass their own dicts or lists of the same shape to the operators.
"""

# --- noise filter (fixed values) ---
MIN_SEVERITY = 0.05
HIGH_SEVERITY = 0.4
MAX_EVENTS_PER_IP_PER_MINUTE = 100
TRUSTED_IPS = ("127.0.0.1", "::1", "192.168.14.137")
NOISE_EVENT_TYPES = ("health_check", "ping", "keepalive", "heartbeat", "metrics_collection", "log_rotation")

# --- correlation words and thresholds (fixed values) ---
FAILURE_WORDS = ("failed", "failure", "invalid", "denied", "authentication_failed", "brute")
SUCCESS_WORDS = ("success", "accepted", "authenticated", "logged_in", "login")
BLOCKED_WORDS = ("block", "deny", "firewall")
OUTBOUND_WORDS = ("outbound", "egress")
BRUTE_FORCE_THRESHOLD = 5
BRUTE_FORCE_SUCCESS_THRESHOLD = 3
PORT_SCAN_THRESHOLD = 10
CORRELATION_WINDOW_S = 360

# --- text sanitising (fixed values; Java regex) ---
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
REDACTED = "[REDACTED]"
TOO_DEEP = "[truncado: demasiado anidado]"
MAX_PAYLOAD_BYTES = 10_485_760
INJECTION_PATTERNS = (
    r"\.\./",
    r"(?is)<script.*?>.*?</script>",
    r"(?i)<script",
    r"(?i)javascript:",
    r"(?iU)on\w+\s*=",
    r"(?iU)<\s*iframe",
    r"(?d)\$\{.*\}",
    r"(?i)__proto__",
    r"(?iU)constructor\s*\[",
    r"(?iU)UNION\s+ALL\s+SELECT",
    r"(?iU)DROP\s+(TABLE|DATABASE|SCHEMA)",
    r"(?iU)DELETE\s+FROM",
    r"(?iU)truncate\s+(table|database)",
)

# --- log source signatures: all keys of one alternative present -> name (fixed values, in order) ---
SOURCE_SIGNATURES = (
    ((("rule", "agent"),), "wazuh"),
    ((("eventSource", "awsRegion"),), "aws_cloudtrail"),
    ((("aid", "ComputerName"),), "crowdstrike"),
    ((("kind",),), "google_workspace"),  # and the value of "kind" starts with KIND_PREFIX
    ((("Workload", "UserId", "AuditData"),), "microsoft_365"),
    ((("StartTime", "LogSource", "Magnitude"),), "qradar"),
    ((("occurredAt", "clientMac"), ("occurredAt", "apMac")), "meraki"),
    ((("topic", "d_id"),), "iot_mqtt"),
    ((("verb", "objectRef", "user"),), "kubernetes_audit"),
    ((("sensor",), ("input", "session")), "honeypot"),
    ((("device", "dst_port"),), "cisco_firewall"),
    ((("_time", "sourcetype"),), "splunk"),
    ((("Severity", "IncidentNumber"),), "microsoft_sentinel"),
)

KIND_PREFIX = "admin#reports"

# --- entity extraction hints (fixed values) ---
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
SOURCE_IP_KEYS = ("src", "src_ip", "srcip", "source", "source_ip", "sourceip", "attacker", "attackerip",
                  "attacker_ip", "remote_ip", "remoteip", "rhost", "origin", "client_ip", "clientip", "src_host")
VICTIM_IP_KEYS = ("dst", "dst_ip", "dstip", "destination", "destip", "target", "target_ip", "victim", "victim_ip",
                  "local_ip", "localip", "server_ip", "serverip", "agent_ip", "agentip")
AGENT_PARENTS = ("agent", "manager", "reporter", "observer", "host")
FORENSIC_PARENTS = ("data", "event", "full_log", "previous_output")
ASSET_KEYS = ("name", "hostname", "asset_id", "agent_name")
EVENT_KEYS = ("description", "event_type", "full_log")
EVENT_MARKERS = ("PAM", "failed", "blocked")

# --- attack pattern families: (pattern, confidence, regexes, reason) in order (fixed values) ---
PATTERN_FAMILIES = (
    ("ransomware_activity", 0.95,
     (r"vssadmin.delete.shadows", r"delete.shadows", r"multiple.file.delete", r"ransomware", r"wbadmin.delete",
      r"bcdedit.*recoveryenabled.no"),
     "Eliminación de shadow copies o actividad masiva de borrado de archivos."),
    ("c2_reverse_shell", 0.95,
     (r"nc[.\s]+-e.cmd", r"nc[.\s]+-e./bin/bash", r"python.*pty\.spawn.*bash", r"reverse.shell", r"c2", r"beacon",
      r"cobalt.strike", r"asyncrat", r"/bin/bash.*socket", r"4444|4445|1337"),
     "Comando de reverse shell o conexión a C2 detectado."),
    ("persistence", 0.85,
     (r"schtask", r"scheduled.task", r"taskname", r"reg.add.*run", r"hklm.*run", r"hkcu.*run", r"new.service",
      r"sc.create", r"crontab.*-[el]", r"\.bashrc|\.profile|\.bash_profile"),
     "Creación de tarea programada, servicio o clave de registro para persistencia."),
    ("privilege_escalation", 0.9,
     (r"net.group.*domain.admins.*\/add", r"net.localgroup.administrators.*\/add", r"globaladmin",
      r"adminmemberadded", r"add_user_to_admin", r"attachuserpolicy.*administratoraccess", r"external_hacker",
      r"backdoor_user"),
     "Usuario añadido a grupo de administradores o rol de alto privilegio."),
    ("defense_evasion", 0.9,
     (r"reg.delete.*windows.defender", r"stopservice.*windefend", r"disable.*defender", r"stoplogging",
      r"archivefindings", r"audit.log.*cleared", r"history.-c", r"rm.*\/var\/log", r"disablekey"),
     "Intento de desactivar defensas, borrar logs o evadir detección."),
    ("credential_theft", 0.9,
     (r"lsass.*\.dmp", r"procdump.*lsass", r"mimikatz", r"comsvcs.*minidump", r"credential.dump", r"\/etc\/shadow",
      r"cat.\/etc\/passwd", r"hashdump"),
     "Volcado de credenciales o acceso a archivos de contraseñas del sistema."),
    ("reconnaissance", 0.75,
     (r"nmap", r"port.scan", r"masscan", r"portscan", r"network.scan", r"syn.flood", r"list.secrets",
      r"describeinstances", r"listbuckets", r"getbucketlocation", r"getcalleridentity", r"find.*-perm.*4000",
      r"crontab.-l", r"whoami", r"sudo.-l", r"netstat.-a"),
     "Actividad de reconocimiento: enumeración de recursos, usuarios o configuración."),
    ("data_exfiltration", 0.8,
     (r"filedownloaded", r"file.downloaded", r"mysqldump", r"pg_dump", r"large.transfer", r"exfil",
      r"transfer.document.ownership", r"delete.drive.item", r"filedeleted.*backup",
      r"operation.*filedownloaded.*analista"),
     "Descarga masiva de archivos o transferencia sospechosa de datos."),
    ("suspicious_execution", 0.85,
     (r"powershell.*-enc", r"powershell.*-nop.*hidden", r"iex.*new-object.*webclient", r"base64.*encoded",
      r"wscript", r"cscript", r"mshta", r"regsvr32", r"rundll32", r"authorize_api_client.*untrusted"),
     "Ejecución sospechosa: script ofuscado, descarga en memoria o LOLBin."),
    ("web_attack", 0.85,
     (r"' or '1'='1", r"sqli.pattern", r"sql.injection", r"<script.*alert", r"xss.detected",
      r"\/etc\/passwd.*(403|200)", r"\/admin\/config", r"web.exploit"),
     "Intento de ataque web: inyección SQL, XSS o acceso a recursos sensibles."),
    ("brute_force_attempt", 0.8,
     (r"wpa.authentication.failure", r"failed.password", r"authentication.fail", r"invalid.user", r"bad.password",
      r"login.failure", r"login_failure", r"event_4625", r"multiple.failed"),
     "Múltiples fallos de autenticación o ataque de fuerza bruta."),
    ("iot_anomaly", 0.8,
     (r"override_open", r"valve.*override", r"factory.*boiler", r"pressure.*psi", r"temp.*critical",
      r"sensor.*anomaly"),
     "Comportamiento anómalo en dispositivo IoT / sistema de control industrial."),
    ("cloud_attack", 0.85,
     (r"verb.*delete.*objectref.*deployment", r'"verb".*"delete"', r"delete.*deployment", r"delete.*namespace",
      r"external.hacker.*delete", r"delete.*database"),
     "Eliminación destructiva de recursos en clúster Kubernetes."),
    ("cloud_attack", 0.9,
     (r"createuser.*backdoor", r"createbackdoor", r"putbucketpolicy.*root", r"deletedbinstance", r"deletebucket",
      r"terminateinstances"),
     "Actividad destructiva o de backdoor en infraestructura cloud."),
    ("wireless_threat", 0.8,
     (r"rogue.access.point", r"evil.twin", r"deauth", r"deauthenticated"),
     "Punto de acceso malicioso o ataque de deautenticación WiFi."),
)
SUPPRESSED_BY = {"data_exfiltration": "c2_reverse_shell"}
HIGH_SEVERITY_EVENT = ("high_severity_event", 0.5,
                       "Evento de alta severidad sin patrón específico identificado.")
NO_PATTERN = ("none", 0.0, "Sin patrón de ataque reconocido.")

# --- command risk tiers (fixed values) ---
COMMAND_TIERS = (
    (1.0, ("miner", "ransomware", "nc -e", "pty.spawn", "mimikatz")),
    (0.8, ("wget", "curl", "chmod +x", "base64", "-enc", "rm -rf")),
    (0.6, ("powershell", "cmd.exe", "whoami", "netstat", "lsass")),
    (0.2, ("ls", "ps", "id", "uname", "uptime")),
)
COMMAND_DEFAULT = 0.1

# --- event name danger words (fixed values) ---
DANGER_TIERS = (
    (1.0, ("delete", "destroy", "terminate", "remove", "purge", "wipe", "erase", "disable", "stoplogging",
           "archivefindings", "disablekey", "deletebucket", "deletedbinstance", "deleteuser", "override",
           "emergency_stop", "force_close")),
    (0.5, ("create", "modify", "update", "attach", "put", "set", "change", "add", "insert", "upload", "write",
           "createuser", "attachuserpolicy", "putbucketpolicy", "adminmemberadded", "add_user_to_admin", "transfer",
           "export", "download")),
    (0.1, ("get", "list", "describe", "read", "view", "show", "fetch", "login", "logout", "consolelogin", "check",
           "verify", "navigate", "open", "access")),
)
DANGER_DEFAULT = 0.3
FORCED_DANGER = 0.9

# --- sensor thresholds: keyword -> (normal max, critical max), in order (fixed values) ---
SENSOR_THRESHOLDS = {
    "temp": (60.0, 100.0), "pressure": (20.0, 35.0), "humidity": (80.0, 95.0), "voltage": (250.0, 300.0),
    "current": (15.0, 25.0), "flow": (100.0, 150.0), "vibration": (5.0, 10.0),
}
QUICK_SENSOR_THRESHOLDS = {
    "temp": (60.0, 100.0), "pressure": (20.0, 35.0), "humidity": (80.0, 95.0), "voltage": (250.0, 300.0),
    "current": (15.0, 25.0),
}
FORCED_SENSOR_DANGER = 0.7

# --- address ranges (fixed values) ---
PRIVATE_CIDRS = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8))
INTERNAL_PREFIXES = ("10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "127.")
INTEL_MALICIOUS_SCORE = 25
BLOCKLIST_CONFIDENCE = 90

# --- reasons shown to analysts (fixed values) ---
RESULT_REASONS = {
    "lateral_movement": "Autenticación fallida seguida de éxito desde misma IP en menos de 6 minutos.",
    "brute_force_success": "Ataque de fuerza bruta exitoso — credenciales posiblemente comprometidas.",
    "port_scan": "Alto volumen de conexiones denegadas a múltiples puertos desde misma IP.",
    "c2_beacon": "Conexiones salientes regulares a IP en lista negra — posible C2.",
    "suspicious_outbound": "Tráfico saliente hacia destino inusual o en lista de amenazas.",
}
RESULT_REASON_NONE = "Evento procesado — sin patrón de ataque reconocido."
RESULT_REASON_INTEL = " IP encontrada en feeds de inteligencia de amenazas."
EXPLANATIONS = {
    "severity_score": "La severidad del evento superó el patrón histórico.",
    "timestamp_delta": "La ráfaga de eventos fue demasiado rápida.",
    "asset_value": "Involucra un activo de alto impacto financiero.",
}
EXPLANATION_DEFAULT = "Patrón de comportamiento anómalo detectado."

# --- streaming detector (fixed values) ---
WARMUP_EVENTS = 30
BURN_IN_EVENTS = 500
ANOMALY_AT = 0.30
ESCALATE_AT_BURN_IN = 0.38
ESCALATE_AT = 0.45
HST_TREES = 50
HST_HEIGHT = 15
HST_WINDOW = 2000

# --- model features, in order (fixed values) ---
FEATURES = ("severity_score", "asset_value", "timestamp_delta", "event_type_id", "command_risk", "numeric_anomaly",
            "hour_of_day", "day_of_week", "events_per_minute")
ASSET_VALUE_CEILING = 100_000.0

# --- incident consolidation gap in minutes (fixed values) ---
CONSOLIDATION_MINUTES = {
    "port_scan": 120, "reconnaissance": 120, "brute_force_attempt": 60, "none": 60, "high_severity_event": 30,
    "web_attack": 30, "brute_force_success": 15, "credential_theft": 15, "lateral_movement": 10, "c2_beacon": 10,
    "data_exfiltration": 5, "ransomware_activity": 5, "c2_reverse_shell": 5,
}
CONSOLIDATION_DEFAULT_MINUTES = 120
OPEN_STATUSES = ("PENDING", "IN_PROGRESS", "SHADOW")

# --- ISO 27005 tables: pattern -> (exposure factor, impacted dimensions, yearly cap, event hint) (fixed values) ---
PATTERN_RISK = {
    "ransomware_activity": (0.90, ("disponibilidad", "integridad"), 5.0, "ransom"),
    "data_exfiltration": (0.80, ("confidencialidad",), 12.0, "download"),
    "c2_reverse_shell": (0.75, ("confidencialidad", "disponibilidad"), 12.0, "shell"),
    "credential_theft": (0.70, ("confidencialidad", "integridad"), 24.0, "credential"),
    "cloud_attack": (0.70, ("confidencialidad", "integridad", "disponibilidad"), 12.0, "cloud"),
    "lateral_movement": (0.65, ("confidencialidad", "integridad", "disponibilidad"), 12.0, "auth"),
    "privilege_escalation": (0.60, ("confidencialidad", "integridad"), 24.0, "admin"),
    "c2_beacon": (0.55, ("confidencialidad",), 52.0, "beacon"),
    "brute_force_success": (0.50, ("confidencialidad", "integridad"), 24.0, "login"),
    "defense_evasion": (0.45, ("integridad",), 52.0, "defender"),
    "persistence": (0.40, ("integridad", "disponibilidad"), 52.0, "scheduled"),
    "suspicious_execution": (0.35, ("integridad", "disponibilidad"), 52.0, "exec"),
    "iot_anomaly": (0.35, ("disponibilidad", "integridad"), 52.0, "sensor"),
    "web_attack": (0.30, ("confidencialidad", "integridad"), 52.0, "http"),
    "brute_force_attempt": (0.25, ("disponibilidad",), 365.0, "failed"),
    "wireless_threat": (0.25, ("confidencialidad",), 52.0, "wifi"),
    "reconnaissance": (0.20, ("confidencialidad",), 52.0, "scan"),
    "high_severity_event": (0.40, ("confidencialidad", "integridad", "disponibilidad"), 52.0, "high severity event"),
    "port_scan": (0.15, ("disponibilidad",), 52.0, "scan"),
    "none": (0.10, (), 52.0, "none"),
}
ARO_DEFAULT_CAP = 52.0
ARO_MIN_DAYS, ARO_MAX_DAYS = 30, 365

# --- quick risk tables (fixed values) ---
ASSET_KEYWORD_VALUES = {
    "db": 0.95, "prod": 0.90, "finance": 0.95, "backup": 0.85, "web": 0.60, "api": 0.65, "srv": 0.70, "server": 0.70,
    "cloud": 0.80, "iot": 0.50, "sensor": 0.40, "ws": 0.35, "ventas": 0.40,
}
ASSET_KEYWORD_DEFAULT = 0.5
DEFAULT_ASSET_USD = 50_000.0
QUICK_EXPOSURE = {
    "ransomware_activity": 0.90, "c2_reverse_shell": 0.85, "credential_theft": 0.80, "privilege_escalation": 0.75,
    "defense_evasion": 0.70, "cloud_attack": 0.85, "data_exfiltration": 0.75, "suspicious_execution": 0.65,
    "web_attack": 0.60, "brute_force_attempt": 0.40, "reconnaissance": 0.25, "iot_anomaly": 0.60,
    "wireless_threat": 0.50, "persistence": 0.70, "high_severity_event": 0.55, "none": 0.10,
}
QUICK_EXPOSURE_DEFAULT = 0.20
SENSITIVE_UPLIFT = {"contiene_pii": 0.05, "contiene_pci": 0.08, "contiene_phi": 0.06, "contiene_pfi": 0.07}
QUICK_ARO = {
    "brute_force_attempt": 52.0, "reconnaissance": 24.0, "web_attack": 12.0, "suspicious_execution": 6.0,
    "defense_evasion": 4.0, "privilege_escalation": 3.0, "credential_theft": 3.0, "data_exfiltration": 2.0,
    "persistence": 2.0, "c2_reverse_shell": 1.0, "ransomware_activity": 0.5, "cloud_attack": 2.0, "iot_anomaly": 8.0,
    "wireless_threat": 4.0, "high_severity_event": 1.0, "none": 0.1,
}
QUICK_ARO_DEFAULT = 1.0
CRITICAL_PATTERNS = ("ransomware_activity", "c2_reverse_shell", "credential_theft", "cloud_attack",
                     "privilege_escalation")
HIGH_PATTERNS = ("defense_evasion", "suspicious_execution", "data_exfiltration", "persistence", "web_attack",
                 "iot_anomaly")
ISO_CONTROLS = {
    "ransomware_activity": "A.17.1.1 (Continuidad)", "c2_reverse_shell": "A.12.1.2 (Malware)",
    "credential_theft": "A.9.2.1 (Acceso)", "privilege_escalation": "A.9.4.1 (Privilegios)",
    "defense_evasion": "A.12.4.1 (Logs)", "data_exfiltration": "A.8.2.3 (Transferencia)",
    "brute_force_attempt": "A.9.4.2 (Passwords)", "web_attack": "A.14.2.5 (Ingeniería)",
    "iot_anomaly": "A.13.1.1 (Redes)",
}
ISO_CONTROL_DEFAULT = "A.12.1.1 (Ops)"
# pattern -> impact 0..3 on (confidentiality, integrity, availability)
CIA_IMPACT = {
    "ransomware_activity": (1, 3, 3), "data_exfiltration": (3, 2, 1), "c2_reverse_shell": (3, 3, 2),
    "credential_theft": (3, 1, 1), "privilege_escalation": (2, 3, 2), "defense_evasion": (1, 2, 1),
    "cloud_attack": (3, 2, 3), "suspicious_execution": (1, 2, 2), "web_attack": (2, 2, 2),
    "brute_force_attempt": (2, 1, 1), "brute_force_success": (3, 2, 1), "reconnaissance": (2, 0, 0),
    "port_scan": (1, 0, 0), "iot_anomaly": (1, 2, 3), "wireless_threat": (2, 1, 2), "persistence": (2, 3, 1),
    "high_severity_event": (2, 2, 2), "lateral_movement": (2, 2, 2), "c2_beacon": (3, 2, 1), "none": (0, 0, 0),
}
CIA_IMPACT_DEFAULT = (1, 1, 1)
CIA_LEVELS = ("Ninguno", "Bajo", "Medio", "Alto")
CIA_TEXT = {
    "confidencialidad": ("Sin impacto sobre la confidencialidad.",
                         "Exposicion limitada de datos — monitoreaar accesos.",
                         "Riesgo moderado de filtracion — revisar permisos urgente.",
                         "Confidencialidad comprometida — posible fuga de datos sensibles."),
    "integridad": ("Integridad no afectada.", "Riesgo bajo de modificacion no autorizada.",
                   "Integridad en riesgo — verificar logs de cambios.",
                   "Integridad comprometida — datos pueden haber sido alterados."),
    "disponibilidad": ("Disponibilidad no afectada.", "Impacto menor en disponibilidad.",
                       "Servicio puede verse interrumpido — preparar contingencia.",
                       "Alta probabilidad de interrupcion del servicio — activar BCP."),
}

# --- sandbox money (fixed values) ---
SANDBOX_ASSET_VALUES = (
    (("db", "prod", "finance", "master"), 0.95),
    (("web", "api", "srv", "server"), 0.60),
    (("sensor", "iot", "actuator"), 0.40),
)
SANDBOX_ASSET_DEFAULT = 0.30

# --- column discovery (fixed values, in order of preference) ---
ASSET_COLUMNS = (
    "computername", "hostname", "host", "agent_name", "machine", "requestparameters_instanceid",
    "requestparameters_dbinstanceidentifier", "requestparameters_bucketname", "requestparameters_username",
    "requestparameters_functionname", "device", "sensor", "device_id", "d_id", "sensor_id", "node", "asset_id",
    "logsource", "clientmac", "mac", "clientip", "userid", "user_username", "actor_email", "sourceipaddress",
    "endpoint",
)
MAX_IDENTIFIER_LENGTH = 80
TIME_HINTS = ("time", "date", "timestamp", "@time", "createdat", "occurred")
EVENT_COLUMNS = ("eventname", "operation", "verb", "eventtype", "name", "description")
EXTERNAL_ACTOR = r"(?i)external|hacker|attacker|gmail\.com|hotmail|yahoo"
DANGEROUS_COMMAND = (r"(?i)wget|curl|chmod\s*\+x|miner|nc\s+-e|pty\.spawn|rm\s+-rf|vssadmin|mimikatz|lsass|"
                     r"base64.*-d|powershell.*-enc|iex.*webclient")
EXPLAIN_COMMAND_KEYS = ("input", "CommandLine", "command", "cmd", "cmdline")
EXPLAIN_EVENT_KEYS = ("eventName", "Operation", "EventName", "LowLevelCategory", "events_0_name", "description",
                      "verb", "input")
EXPLAIN_IP_KEYS = ("src_ip", "sourceIPAddress", "ipAddress", "SourceIp", "clientip", "remote_addr")
EXPLAIN_DESTRUCTIVE = "Acciones destructivas detectadas (Delete/Stop/Disable)"
EXPLAIN_FALLBACK = "Desviación estadística multidimensional"

# --- inventory headers: field -> known aliases, in order (fixed values) ---
INVENTORY_ALIASES = {
    "nombre_activo": ("nombre", "nombre activo", "asset", "activo", "asset name", "recurso"),
    "tipo_activo": ("tipo", "tipo activo", "tipo de activo", "categoria", "categoria activo"),
    "hostname": ("host", "hostname", "equipo", "nombre equipo", "nombre del equipo", "server"),
    "ip_address": ("ip", "ip address", "direccion ip", "ipv4", "ip host"),
    "mac_address": ("mac", "mac address", "direccion mac"),
    "technical_id": ("id tecnico", "technical id", "agent id", "sensor id", "uuid agente"),
    "propietario": ("propietario", "dueno", "owner", "responsable", "lider"),
    "custodio": ("custodio", "guardian"),
    "administrador": ("administrador", "admin", "gestor"),
    "propietario_informacion": ("propietario info", "owner info", "dueno informacion"),
    "ubicacion": ("ubicacion", "lugar", "sede", "oficina", "sitio"),
    "departamento": ("departamento", "area", "unidad", "gerencia", "seccion"),
    "descripcion": ("descripcion", "detalle", "resumen", "notas"),
    "observaciones": ("observaciones", "comentarios", "notas adicionales"),
    "estado_parcheo": ("parcheo", "estado parcheo", "parches", "vulnerable", "actualizado"),
    "clasificacion_criticidad": ("criticidad", "clasificacion", "importancia", "nivel", "prioridad"),
    "valor_activo": ("valor", "valor activo", "costo", "monto", "precio", "va"),
    "valor_confidencialidad": ("confidencialidad", "conf", "cia c", "valor c"),
    "valor_integridad": ("integridad", "integr", "cia i", "valor i"),
    "valor_disponibilidad": ("disponibilidad", "disp", "cia d", "valor d"),
    "contiene_pii": ("pii", "datos personales", "informacion personal"),
    "contiene_pci": ("pci", "datos pago", "tarjeta"),
    "contiene_phi": ("phi", "datos salud", "health"),
    "contiene_pfi": ("pfi", "datos financieros", "financiero"),
}
INVENTORY_TYPES = {
    "valor_activo": "decimal", "valor_confidencialidad": "int", "valor_integridad": "int",
    "valor_disponibilidad": "int", "contiene_pii": "bool", "contiene_pci": "bool", "contiene_phi": "bool",
    "contiene_pfi": "bool",
}
TRUE_WORDS = ("si", "sí", "yes", "true", "1", "x", "t", "y")
CRITICALITY_LEVELS = ("Bajo", "Medio", "Alto", "Crítico")

# --- drift (fixed values) ---
DRIFT_FEATURES = ("severity_score", "command_risk", "numeric_anomaly")
DRIFT_BINS = 10
DRIFT_MIN_ROWS = 100
DRIFT_LIMIT = 0.2
